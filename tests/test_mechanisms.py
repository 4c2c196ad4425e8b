"""Streams with state, published tables and joins at instants against plain versions of them."""

import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import tables, versions
from marlstone.sources import files, published
from marlstone.streaming import jobs, rates

SF = "/root/testdata/sf0.01"


def start(stream, to):
    return stream.writeStream.option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start(f"{to}/out", format="parquet")


def test_streamed_verdicts_over_restarts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 40").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    parts = e.withColumn("_part", F.ntile(5).over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts", "event_id"))).cache()
    to = str(tmp_path)
    for k in range(1, 6):  # one file after another; the stream stops in between
        parts.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{to}/in")
        s = spark.readStream.schema(e.schema).parquet(f"{to}/in")
        start(rates.rate_stream(s, "user_id", "ts", "event_id", 2, 36000), to).awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(f"{to}/out").collect()}
    want = {r.event_id: r.allowed for r in jobs.rate_verdict(e, "user_id", "ts", "event_id", 2, 36000).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_verdict():
    times = []
    assert [rates.verdict(times, t, 2, 10) for t in (0, 5, 9, 10, 11, 15)] == [True, True, False, True, False, True]
    assert times == [0, 5, 10, 15] and rates.verdict(times, 3, 2, 10)  # a late one sees what was allowed up to its time


def test_publish(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    with pytest.raises(published.NotPublished):
        published.read(spark, root)
    m = published.publish(a, root, "one", rows=2)
    assert (m["number"], m["rows"]) == (1, 2)
    other = spark.newSession()
    assert sorted(map(tuple, published.read(other, root).collect())) == [(1, "x"), (2, "y")]
    bad = {
        "rows": lambda: published.publish(a, root, "two", rows=3),
        "share": lambda: published.publish(a.limit(0), root, "two", least_share=0.5),
        "schema": lambda: published.publish(a.withColumn("z", F.lit(1)), root, "two"),
        "check": lambda: published.publish(a, root, "two", check=lambda d: d.where("id = 1").count()),
        "job": lambda: published.publish(a.withColumn("v", F.raise_error(F.lit("boom"))), root, "two"),
    }
    for why, run in bad.items():
        with pytest.raises(published.NotPublished if why != "job" else Exception):
            run()
        assert published.current(other, root)["version"] == "one", why
    assert len(list((tmp_path / "index" / "data").iterdir())) == 1  # failed builds leave nothing
    published.publish(spark.createDataFrame([(3, "z")], "id long, v string"), root, "two")
    assert [tuple(r) for r in published.read(other, root).collect()] == [(3, "z")]
    assert published.read(other, root, "one").count() == 2
    assert not published._put(spark, f"{root}/manifests/00000002.json", json.dumps({}))  # two builds cannot both be number 2
    assert published.forget(spark, root, 1) == 1 and [m["version"] for m in published.manifests(spark, root)] == ["two"]


def test_versioned_and_index(spark, tmp_path):
    root = f"file://{tmp_path}/docs"
    a = spark.createDataFrame([(1,)], "id long")
    assert files.write_versioned(a, root, "1") and not files.write_versioned(a, root, "2", failures=a)
    assert not tables.publish_index(a, root, "3", False) and tables.publish_index(a, root, "4", True)
    assert published.current(spark, root)["version"] == "4"


def test_as_of_join_by_brute_force(spark):
    r = random.Random(8)
    obs = [(r.randint(0, 5), r.randint(0, 60), r.choice("ab")) for _ in range(120)]
    v = versions.version_history(spark.createDataFrame([(*x, i) for i, x in enumerate(obs)], "e int, t int, s string, n int"), "e", "t", "s", "n")
    v = v.withColumn("valid_to", F.when((F.col("version_no") % 4 == 1) & F.col("valid_to").isNotNull(), F.col("valid_to") - 1).otherwise(F.col("valid_to")))  # gaps
    v = v.withColumn("valid_from", F.when((F.col("version_no") == 1) & (F.col("e") == 2), None).otherwise(F.col("valid_from")))
    held = [(x.e, x.valid_from, x.valid_to, x.version_no, x.s) for x in v.collect()]
    points = [(i, r.choice([0, 1, 2, 3, 4, 5, 9, None]), r.choice([None, *range(-3, 70)]), "p") for i in range(300)]
    got = versions.as_of_join(spark.createDataFrame(points, "i int, e int, at int, s string"), v, "e", "at", ["version_no", "s"])
    assert got.columns == ["i", "e", "at", "s", "version_no", "s_at"]

    def plain(e, at):
        if e is None or at is None:
            return None, None
        hit = [(n, s) for x, a, b, n, s in held if x == e and (a is None or a <= at) and (b is None or b > at) and a != b]
        assert len(hit) <= 1
        return hit[0] if hit else (None, None)

    assert {x.i: (x.version_no, x.s_at) for x in got.collect()} == {i: plain(e, at) for i, e, at, _ in points}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_join_has_one_exchange(spark, tmp_path):
    spark.range(10).selectExpr("id as e", "id as valid_from", "id + 5 as valid_to", "id as x").write.parquet(f"{tmp_path}/v")
    spark.range(10).selectExpr("id as e", "id as at").write.parquet(f"{tmp_path}/p")
    j = versions.as_of_join(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/v"), "e", "at", ["x"])
    assert j._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert j.where("x = e").count() == 10


def test_declared_start(spark):
    rows = [(1, 10, "a", 3, 0), (1, 12, "b", 1, 1), (2, 5, "a", None, 2), (3, 5, "a", 9, 3)]
    h = versions.version_history(spark.createDataFrame(rows, "e int, t int, s string, d int, n int"), "e", "t", "s", "n", "d").orderBy("e", "version_no").collect()
    assert [(r.e, r.valid_from, r.valid_to) for r in h] == [(1, 3, 12), (1, 12, None), (2, 5, None), (3, 5, None)]


def test_line_numbers_over_splits(spark, tmp_path):
    row = lambda v, d, c: json.dumps({"version_id": v, "document_id": d, "is_current": c})
    lines = [row(str(i), f"d{i}", True) for i in range(300)]
    lines[40], lines[41], lines[250], lines[299] = "{bad", "", row("7", "z", False), json.dumps({"title": "x"})
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n" + row("n", "d0", True) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        numbered = files.numbered_lines(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() > 3
        want = {(f, i + 1): x for f, xs in (("a.jsonl", lines), ("b.jsonl", ["", row("n", "d0", True)])) for i, x in enumerate(xs)}
        assert {(r.file.rsplit("/", 1)[1], r.line): r.value for r in numbered.collect()} == want
        ok, bad = files.read_documents(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.line): r.reason for r in bad.collect()}
        assert got == {("a.jsonl", 41): "invalid_json", ("a.jsonl", 300): "missing_id", ("a.jsonl", 8): "duplicate_version", ("a.jsonl", 251): "duplicate_version", ("a.jsonl", 1): "many_current", ("b.jsonl", 2): "many_current"}
        assert ok.count() == 300 - 6  # a blank line, and five that are rejected here
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ingest_reads_only_its_buckets(spark, tmp_path):
    to, target = str(tmp_path), f"{tmp_path}/out"
    spark.createDataFrame([(f"k{i}", i) for i in range(50)], "id string, n int").write.parquet(f"{to}/in")
    run = lambda ck: jobs.ingest(spark.readStream.schema("id string, n int").parquet(f"{to}/in"), lambda d: d.where("n <> 13"), "id", target, f"{to}/{ck}", 8).awaitTermination()
    for ck in ("a", "b", "a"):  # replayed from the start, and resumed
        run(ck)
        assert sorted(r.n for r in spark.read.parquet(target).collect()) == [i for i in range(50) if i != 13]
    one = spark.createDataFrame([("k3", 3), ("new", 99), ("new", 99)], "id string, n int")
    fresh = jobs.fresh_rows(one, target, "id", 8)
    assert [r.id for r in fresh.collect()] == ["new"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan or "_bucket#" in plan.split("PartitionFilters: ")[1][:60]


def test_late_events_are_counted(spark, tmp_path):
    to = str(tmp_path)
    batches = [[("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:05:00")], [("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:04:30"), (None, "2024-01-01 00:06:00")], [("a", "2024-01-01 00:00:20"), ("a", "2024-01-01 00:05:59"), ("a", None)]]
    for b in batches:
        spark.createDataFrame(b, "k string, t string").select("k", F.to_timestamp("t").alias("t")).coalesce(1).write.mode("append").parquet(f"{to}/in")
        s = spark.readStream.schema("k string, t timestamp").parquet(f"{to}/in")
        jobs.count_events(s, "t", "k", 60, 120, f"{to}/out", f"{to}/ck").awaitTermination()
    got = {(str(r.start)[14:16], r.kind): (r.n, r.n_late) for r in jobs.window_counts(spark, f"{to}/out").collect()}
    assert got == {("00", "a"): (1, 2), ("05", "a"): (2, 0), ("04", "b"): (1, 0), ("06", None): (1, 0)}


def test_contract_of_runs(spark):
    from marlstone.operators import scoring

    tasks = spark.createDataFrame([("t1", "1", "v", "write it", ["a"]), ("t2", "1", "v", None, None)], "task_id string, task_revision string, validator_sha256 string, prompt string, tags array<string>")
    prints = {r.task_id: r.f for r in tasks.select("task_id", scoring.fingerprint(["prompt", "tags"]).alias("f")).collect()}
    import hashlib

    assert prints["t1"] == hashlib.sha256(b'{"prompt":"write it","tags":["a"]}').hexdigest() and prints["t2"] == hashlib.sha256(b'{"prompt":null,"tags":null}').hexdigest()
    run = lambda i, t, rev="1", v="v", f=None, p="p": (i, t, rev, v, f or prints.get(t), p)
    runs = [run("a", "t1"), run("b", "t1", rev="2"), run("c", "t1", v="w", f="x"), run("d", "t9"), run("e", "t2", p="p"), run("f", "t2", p="q"), run("g", "t2", rev="0", p="r"), run("h", "t1", v=None)]
    d = spark.createDataFrame(runs, "run_id string, task_id string, task_revision string, validator_sha256 string, task_fingerprint string, protocol_sha256 string")
    got = {r.run_id: (r.reject, r.mismatches and list(r.mismatches)) for r in scoring.validate_runs(d, tasks, definition=["prompt", "tags"]).collect()}
    assert got == {
        "a": (None, []), "b": ("contract_mismatch", ["task_revision"]), "c": ("contract_mismatch", ["task_fingerprint", "validator_sha256"]), "d": ("unknown_task", None),
        "e": ("mixed_protocol", []), "f": ("mixed_protocol", []), "g": ("contract_mismatch", ["task_revision"]), "h": ("contract_mismatch", ["validator_sha256"]),
    }
    with pytest.raises(Exception, match="task listed twice"):
        scoring.validate_runs(d, tasks.unionByName(tasks)).collect()


def test_addresses(spark):
    from marlstone.operators import prepare

    table = {
        "https://Bücher.Example/a": "https://xn--bcher-kva.example/a", "//cdn.x.com/y": "https://cdn.x.com/y", "Example.com/Path": "https://example.com/Path", "example.com": "https://example.com/",
        "http://User:Pw@HOST.com:80/": "http://User:Pw@host.com/", "https://h.com:8443//a/./b/../c/": "https://h.com:8443/a/c", "http://h.com/ü b?q=a%20b&z=ü": "http://h.com/%C3%BC%20b?q=a+b&z=%C3%BC",
        "http://h.com/?b=2&a1=x&a=y&utm_x=1&FBCLID=2": "http://h.com/?a=y&a1=x&b=2", "http://h.com/?x=a=b&y": "http://h.com/?x=a%3Db&y=", "doc-17#frag": "doc-17", "a/b.html": "a/b.html", "ＨＴＴＰ://ｈ.com/": "http://h.com/",
        "http://h.com/a%2Fb": "http://h.com/a%2Fb", "http://h.com/?k=1%262": "http://h.com/?k=1%262", "": "",
    }
    d = spark.createDataFrame([(k,) for k in table], "u string")
    assert {r.u: r.c for r in d.select("u", prepare.canonical_url(F.col("u")).alias("c")).collect()} == table
