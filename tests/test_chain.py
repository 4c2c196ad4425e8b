"""The answer chain: against the plain chain where nothing is filtered, and by hand where filters, times and facts matter."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chain, retrieval

NOW = "2024-06-30"
KIND = "id long, text string, level string, fact string, competitor string, published timestamp, is_current boolean, product_version string, valid_from timestamp, valid_to timestamp, plan_name string, source_type string, price_value string"


def day(m, d):
    return datetime.datetime(2024, m, d)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "Acme pro price is 20 dollars\nother line", "A", "f", "acme", day(6, 25), True, "2.0", day(6, 1), None, "Pro", "pricing", "20"),
        (2, "Acme pro price was 18 dollars", "B", "f", "acme", day(6, 24), True, "1.0", day(1, 1), None, "Pro", "pricing", "18"),
        (3, "Acme news about the price", "C", None, "acme", day(1, 2), False, None, None, None, None, None, None),
        (4, "Other firm pro price list", "A", None, "other", day(6, 20), True, None, None, None, None, None, None),
        (5, "nothing of use", "D", None, "acme", None, True, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, KIND)


def test_filters_evidence_and_conflicts(spark, chunks):
    q = spark.createDataFrame([(1, "acme pro price last 2 weeks"), (2, "pro price"), (3, "zzz"), (4, "acme")], "q int, text string")
    names = spark.createDataFrame([("acme", "Acme")], "alias string, canonical string")
    more = spark.createDataFrame([("price", "dollars", 1)], "term string, synonym string, seq int")
    got = chain.answer(q, chunks, "q", "id", F.lit(NOW).cast("timestamp"), aliases=names, synonyms=more, k=3)
    results = {}
    for r in got["results"].orderBy("q", "rank").collect():
        results.setdefault(r.q, []).append(r.id)
    assert sorted(results[1]) == [1, 2] and set(results[2]) <= {1, 2, 3, 4} and 4 in results[2] and 3 not in results and set(results[4]) <= {1, 2, 3, 5}
    trace = {(r.q, r.stage): r.n for r in got["trace"].collect()}
    assert [trace[i, "filtered"] for i in (1, 2, 3, 4)] == [2, 5, 5, 4] and trace[3, "final"] == 0 and trace[1, "final"] == trace[1, "evidence"] == 2
    assert [trace[i, "conflicts"] for i in (1, 3)] == [1, 0]
    proof = {(r.q, r.id): (r.quote, r.position) for r in got["evidence"].collect()}
    assert proof[1, 1] == ("Acme pro price is 20 dollars", results[1].index(1) + 1)
    (c,) = [r for r in got["conflicts"].collect() if r.q == 1]
    assert (c.entity, c.field, list(c.conflict_values), c.preferred) == ("Pro", "price_value", ["18", "20"], 1)


def test_nothing_filtered_is_the_plain_chain(spark):
    sf = "/root/testdata/sf0.001"
    q = spark.read.parquet(f"{sf}/benchmark.parquet").limit(10)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("B").alias("level"), F.col("source").alias("fact"), F.col("source").alias("competitor"))
    got = chain.answer(q, d, "item_id", "doc_id", F.lit(NOW).cast("timestamp"), temporal=False, k=5)["results"]
    want = retrieval.retrieve(q, d, "item_id", "doc_id").where("rank <= 5")
    key = lambda t: sorted((r.item_id, r.doc_id, r["rank"], r.bm25_rank, r.dense_rank, round(r.final_score, 6)) for r in t.collect())
    assert key(got) == key(want)


def test_scoped_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [1.0, 0.0], "none")], "id long, embedding array<double>, s string")
    v = spark.createDataFrame([(10, [1.0, 0.0], ["a"]), (11, [1.0, 1.0], ["a", "b"]), (12, [0.0, 1.0], ["b"]), (13, [2.0, 0.0], [])], "id long, embedding array<double>, inside array<string>")
    got = [(r.query_id, r.id, r["rank"]) for r in retrieval.dense_topk(q, v, 5, id_col="id", scope=("s", "inside")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 10, 1), (1, 11, 2), (2, 11, 1), (2, 12, 2)]
