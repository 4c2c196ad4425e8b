"""Sinks, releases, traces and configuration over generated files."""

import csv
import json

from pyspark.sql import functions as F

from marlstone.sources import files


def test_raw_and_review(spark, tmp_path):
    kind = "competitor string, source_type string, crawl_run_id string, requested_url string, payload_hash string, payload binary, fetched_at timestamp"
    d = spark.createDataFrame([("a", "blog", "r1", "http://x", "h", b"1", None), ("a", "blog", "r1", "http://y", None, None, None)], kind)
    files.write_raw(d, f"{tmp_path}/raw")
    files.write_raw(d.where("payload is not null"), f"{tmp_path}/raw")
    back = spark.read.parquet(f"{tmp_path}/raw")
    assert back.count() == 3 and back.select("raw_record_id").distinct().count() == 2 and (tmp_path / "raw" / "competitor=a" / "source_type=blog" / "crawl_run_id=r1").is_dir()
    audit = spark.createDataFrame([(1, "PASS", []), (2, "FAIL", ["email", "noise"])], "doc_id long, decision string, findings array<string>")
    files.write_review_queue(audit.coalesce(1), f"{tmp_path}/queue")
    (part,) = (tmp_path / "queue").glob("part-*.csv")
    (row,) = csv.DictReader(part.open(), escapechar="\\")
    assert row["doc_id"] == "2" and json.loads(row["findings"]) == ["email", "noise"]


def test_releases(spark, tmp_path):
    one = {"id": 1, "tag_name": "v1", "name": "One", "body": "b", "author": {"login": "u"}, "published_at": None, "created_at": "2024-02-01T00:00:00Z"}
    (tmp_path / "r.json").write_text(json.dumps([one, one | {"id": 2, "published_at": "2023-01-01T00:00:00Z"}, one | {"id": 3, "published_at": "2024-01-01T00:00:00Z"}]))
    got = files.releases(spark, str(tmp_path), "2024-01-01T00:00:00Z")
    assert sorted((r.id, r.tag_name, r.author) for r in got.collect()) == [(1, "v1", "u"), (3, "v1", "u")]


def test_traces_and_configuration(spark, tmp_path):
    t = spark.createDataFrame([(1, "bm25", 20)], "q int, stage string, n int")
    for _ in range(2):
        files.append_trace(t, f"{tmp_path}/trace")
    assert spark.read.parquet(f"{tmp_path}/trace").groupBy("stage").agg(F.sum("n")).collect()[0][1] == 40
    got = files.read_config_table(spark, {"D1": ["a", "b"], "D2": ["c"]}, "code", "alias")
    assert sorted(map(tuple, got.collect())) == [("D1", "a", 0), ("D1", "b", 1), ("D2", "c", 0)]
