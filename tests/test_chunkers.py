"""Release, price, issue and dated sections with the cases that matter, conflicts of normalised values, numbered quotes."""

import datetime

from pyspark.sql import functions as F

from marlstone.operators import chunks, evidence


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_release_boundaries(spark):
    t = "intro\nVersion 1.2.0\nfirst\n1.5 times faster than before\nrelease v2.0-beta.1  \n### Fixed bugs\n- a\nv3.1 is out\n## 4.0 Security\nx\n2.0"
    got = [(r.version, r.change_category, list(r.path), t[r.char_start : r.char_end].split("\n")[0]) for r in chunks.release_sections(docs(spark, t)).orderBy("section").collect()]
    assert got == [
        (None, "other", [], "intro"), ("1.2.0", "other", ["Version 1.2.0"], "Version 1.2.0"), ("2.0-beta.1", "other", ["release v2.0-beta.1"], "release v2.0-beta.1  "),
        ("2.0-beta.1", "fixes", ["Fixed bugs", "release v2.0-beta.1"], "### Fixed bugs"), ("4.0", "security", ["4.0 Security"], "## 4.0 Security"),
    ]


PRICES = "# Pricing\nAll plans.\n## Pro\nBest for teams\n$1,200 per user / month\n## **Growth**\n\nContact sales\n## Team plan\nRMB 99.50/yr\n## FAQ\n### Is Pro free\n$3\n## How it works\n$7\n## Hobby\nfree\n## Notes\na\nb\nc\nd\nEUR 1,5 monthly"


def test_plans(spark):
    got = [(r.plan_name, r.section_type, list(r.applicable_plans), r.price_value, r.currency, r.billing_period) for r in chunks.plan_chunks(docs(spark, PRICES)).orderBy("section").collect()]
    every = ["Pro", "Growth", "Team plan", "Hobby"]
    common = lambda *x: (None, "pricing_common", every, *x)
    plan = lambda n, *x: (n, "pricing_plan", [n], *x)
    assert got == [
        common(None, None, None), plan("Pro", 1200.0, "USD", "month"), plan("Growth", None, None, None), plan("Team plan", 99.5, "CNY", "year"),
        common(3.0, "USD", None), common(7.0, "USD", None), plan("Hobby", 0.0, None, None), common(15.0, "EUR", None),
    ]


def test_dispatch(spark):
    issue = "It breaks\nComment by ann at 2024-05-01T10:00:00Z\nmine too\nComment by bob\n\nfixed"
    dated = "lead\n## 2024-02-01 One\na\n| 2024-03-01 | row text |\n| --- | --- |\nloose"
    rows = [(1, PRICES, "pricing"), (2, "v1.0\nx", "rss"), (3, issue, "issue"), (4, dated, "dated_changelog"), (5, "# A\nbody", "blog"), (6, "plain", None), (7, None, "pricing")]
    got = chunks.chunk_documents(spark.createDataFrame(rows, "doc_id long, text string, source_type string")).collect()
    by = lambda i: sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_index)
    text = {i: t for i, t, _ in rows}
    assert all(text[r.doc_id][r.char_start : r.char_end] == r.content for r in got) and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6}
    assert [r.plan_name for r in by(1) if r.plan_name] == ["Pro", "Growth", "Team plan", "Hobby"] and by(2)[0].version == "1.0"
    assert [(r.section_type, r.author, r.comment_time and r.comment_time.isoformat()[:10]) for r in by(3)] == [("body", None, None), ("comment", "ann", "2024-05-01"), ("comment", "bob", None)]
    assert [(str(r.date), r.label, r.content) for r in by(4)] == [("2024-02-01", "2024-02-01 One", "## 2024-02-01 One\na"), ("2024-03-01", "row text", "| 2024-03-01 | row text |")]


def test_dated_sections(spark):
    s = docs(spark, "# 2024-01-02 x\na\n# 2023-01-01 old\nb\n# 2024-01-02 x\nc")
    assert [(str(x.date), x.ordinal) for x in chunks.dated_sections(s, "2024-01-01").orderBy("ordinal").collect()] == [("2024-01-02", 1), ("2024-01-02", 2)]


def test_registered_chunker(spark):
    chunks.register_chunker("short", lambda d: d.select("doc_id", F.lit("own").alias("section_type"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.col("text").alias("content")))
    try:
        got = chunks.chunk_documents(spark.createDataFrame([(1, "abc", "short"), (2, "def", "x")], "doc_id long, text string, source_type string")).collect()
        assert {(r.doc_id, r.section_type) for r in got} == {(1, "own"), (2, None)}
    finally:
        chunks._chunkers.pop("short")


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_conflicts_of_normalised_values(spark):
    kind = "chunk string, entity string, field string, value string, is_current boolean, evidence_level string, publish_time timestamp, final_score double, valid_from timestamp, valid_to timestamp"
    rows = [
        ("old", "Pro", "price", "18", False, "B", day(0), 9.0, day(0), day(200)), ("new", "pro ", "Price", "20", True, "A", day(1), 1.0, day(100), None),
        ("a", "X", "price", "$10", True, "A", day(0), 1.0, None, None), ("b", "x", "price", " $10 ", True, "B", day(0), 1.0, None, None),
        ("c", "Y", "state", "Open", True, "B", day(5), 1.0, None, None), ("d", "Y", "state", "closed", True, "B", day(5), 2.0, None, None), ("e", "Y", "state", "OPEN", True, "D", day(9), 3.0, None, None),
        ("f", "Z", "p", "1", True, "A", day(0), 1.0, day(0), day(5)), ("g", "Z", "p", "2", True, "A", day(0), 1.0, day(5), None),
        ("h", "W", "p", "1", True, "A", day(0), 1.0, None, None), ("h", "W", "p", "2", True, "A", day(0), 1.0, None, None),
    ]
    got = {r.entity.strip().lower(): (r.n_pairs, list(r.conflict_values), list(r.chunks), r.preferred) for r in evidence.detect_conflicts(spark.createDataFrame(rows, kind), ["entity", "field"], "chunk").collect()}
    assert got == {"pro": (1, ["18", "20"], ["new", "old"], "new"), "y": (2, ["OPEN", "closed"], ["c", "d", "e"], "d")}


def test_numbered_quotes(spark):
    e = spark.createDataFrame([("q", "see [12] there", 1), ("q", "and  more", 2), ("q", "cut", 4), ("r", "only", 2)], "q string, quote string, position int")
    got = {r.q: (r.answer, r.n_quotes, r.valid) for r in evidence.extractive_answers(e, "q").collect()}
    assert got == {"q": ("see [12] there [1]\nand more [2]", 2, True), "r": ("only [2]", 1, False)}
