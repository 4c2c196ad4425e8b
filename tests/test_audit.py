"""Checks of contents, labels, captures, citations, facts, cases, cards and cohorts on hand-made rows."""

import datetime
import hashlib

from pyspark.sql import functions as F

from marlstone.operators import audit, evaluate, evidence, labels, scoring

NOW = datetime.datetime(2024, 1, 20)
DAY = datetime.timedelta(days=1)


def test_content_checks(spark):
    kind = "doc_id string, url string, title string, content string, content_hash string, source_type string, crawl_time timestamp, valid_from timestamp, valid_to timestamp, is_current boolean"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    good = dict(url="https://e.com/a", title="t", content="x" * 80, source="page", at=NOW, a=NOW - DAY, b=None, cur=True)
    row = lambda i, **x: (lambda g: (i, g["url"], g["title"], g["content"], g.get("hash") or (digest(g["content"]) if g["content"] else None), g["source"], g["at"], g["a"], g["b"], g["cur"]))(good | x)
    cases = {
        "fine": ({}, []),
        "hash": ({"hash": "0"}, ["hash_mismatch"]),
        "ftp": ({"url": "ftp://e.com/a"}, ["url_invalid"]),
        "no url": ({"url": None}, ["url_invalid"]),
        "tracked": ({"url": "https://E.com/a?utm_source=x"}, ["url_not_canonical"]),
        "short": ({"content": "x" * 79}, ["too_short"]),
        "own least": ({"source": "pricing"}, ["too_short"]),
        "fallback": ({"title": audit.FALLBACK_TITLE}, ["untitled"]),
        "no title": ({"title": None}, ["untitled"]),
        "a day ahead": ({"at": NOW + DAY}, []),
        "later": ({"at": NOW + DAY + datetime.timedelta(seconds=1)}, ["future_time"]),
        "backwards": ({"b": NOW - 2 * DAY, "cur": False}, ["bad_interval"]),
        "ended": ({"b": NOW}, ["current_has_end"]),
        "open": ({"cur": False}, ["historical_lacks_end"]),
        "nulls": ({"content": None, "source": None, "at": None, "a": None, "cur": None}, []),
    }
    docs = spark.createDataFrame([row(i, **x) for i, (x, _) in cases.items()], kind)
    got = {r.doc_id: list(r.findings) for r in audit.content_checks(docs, F.lit(NOW), {"pricing": 200}).collect()}
    assert got == {i: want for i, (_, want) in cases.items()}
    assert audit.content_checks(docs.select("doc_id"), F.lit(NOW)).first().findings == []
    assert audit.content_checks(docs.limit(0), F.lit(NOW)).count() == 0


def test_label_drift(spark):
    docs = spark.createDataFrame([("a", "fast and safe", "E1"), ("b", "nothing", "E1"), ("c", "fast", None), ("gone", "fast", None)], "doc_id string, text string, event_type string")
    now = labels.label(docs, F.col("text"), {"D1": ["fast"], "D2": ["safe"]})
    check = lambda stored: {r.doc_id: list(r.findings) for r in audit.label_drift(stored, now.where("doc_id <> 'gone'")).collect()}
    same = check(now)
    assert same["a"] == [] and same["b"] == ["no_dimension"] and same["c"] == []
    assert same["gone"] == ["dimension_mismatch", "confidence_mismatch", "reasons_mismatch", "review_flag_mismatch", "evidence_missing"]
    old = check(labels.label(docs, F.col("text"), {"D1": ["fast"]}).withColumn("event_type", F.lit("E2")))
    assert old["a"] == ["event_mismatch", "dimension_mismatch", "confidence_mismatch", "reasons_mismatch"]
    assert check(now.withColumn("needs_browser", F.lit(True)))["a"] == ["reasons_mismatch", "review_flag_mismatch", "needs_browser"]
    more = now.withColumn("dimension_tags", F.array(F.lit("D1"), F.lit("D2"), F.lit("D9")))
    assert check(more)["a"] == ["dimension_mismatch", "evidence_missing"]


def test_lineage_checks(spark):
    capture = lambda i, **x: (i, x.get("path", "p"), "page", "Acme ", x.get("error"), x.get("status", 200), x.get("stated", "h"), x.get("digest", "h"))
    captures = spark.createDataFrame([capture("ok"), capture("bad", stated="x", status=404, error="timeout"), capture("none", digest=None, status=None)], "raw_record_id string, path string, source_type string, competitor string, error string, http_status int, payload_hash string, digest string")
    docs = spark.createDataFrame([(1, "ok", "p", "page", "acme", "h"), (2, "ok", "q", "feed", "other", "y"), (3, "bad", "p", "page", None, None), (4, "none", "p", "page", "", None), (5, "nowhere", "p", "page", None, None), (6, None, "p", "page", None, None)], "doc_id int, raw_record_id string, raw_path string, source_type string, competitor string, payload_hash string")
    got = {r.doc_id: list(r.findings) for r in audit.lineage_checks(docs, captures).collect()}
    assert got == {
        1: [],
        2: ["path_mismatch", "source_mismatch", "competitor_mismatch", "document_hash_mismatch"],
        3: ["acquisition_error", "status_invalid", "payload_hash_mismatch"],
        4: ["payload_missing", "status_invalid"],
        5: ["capture_missing"],
        6: ["capture_missing"],
    }


def test_citations(spark):
    ev = spark.createDataFrame([("q", "c1", "Fast &amp; safe:  it\nends here.", "https://E.com/a/", "Title", 5, NOW, "A"), ("r", "c2", "other", "https://e.com/b", "T", 0, None, "d"), ("q", "c3", "text", "none", "T", 0, None, "B")], "query_id string, chunk_id string, text string, url string, title string, char_start int, publish_time timestamp, evidence_level string")
    cite = lambda i, c="c1", quote="fast & SAFE: it ends", **x: (i, "q", c, quote, x.get("url"), x.get("title"), x.get("start"), x.get("at"))
    cases = [
        (cite("fine", url="HTTPS://e.com/a#x", title=" title ", start=5, at=NOW), [], []),
        (cite("parts", quote="fast … it ends..."), [], []),
        (cite("order", quote="ends … fast"), ["quote_absent"], []),
        (cite("one part", quote="fast & safe: it ends…"), ["quote_absent"], []),
        (cite("joined", quote="fast & safe:it"), ["quote_absent"], []),
        (cite("no quote", quote=None), [], ["no_quote"]),
        (cite("url", url="https://e.com/c"), ["url_mismatch"], []),
        (cite("bad url", url="e.com"), ["url_invalid"], []),
        (cite("fields", title="other", start=6, at=NOW + DAY), ["title_mismatch", "char_start_mismatch", "publish_time_mismatch"], []),
        (cite("scope", "c2", "other"), ["out_of_scope"], ["weak_level"]),
        (cite("source url", "c3", "text"), ["url_invalid"], []),
        (cite("unknown", "c9", "x", url="bad"), ["unknown_chunk"], []),
        (cite("null", None, "x"), ["unknown_chunk"], []),
    ]
    ci = spark.createDataFrame([x for x, _, _ in cases], "i string, query_id string, chunk_id string, quote string, url string, title string, char_start int, publish_time timestamp")
    got = {r.i: (list(r.findings), list(r.warnings)) for r in evidence.validate_citations(ci, ev).collect()}
    assert got == {x[0]: (f, w) for x, f, w in cases}


def test_stated_facts(spark):
    kind = "chunk_id string, facts array<struct<field:string,value:string,entity:string>>, fact_field string, fact_value string, source_type string, plan_name string, price_value double, currency string, repository string, github_number int, github_state string"
    rows = [
        ("a", [("Seats", "5", None), ("seats", " 5 ", "Default"), ("seats", "6", None), ("x", "", None), (None, "y", None)], "tier", "Pro", None, None, None, None, None, None, None),
        ("b", None, None, None, "pricing", "Team", 9.5, "USD", None, None, None),
        ("c", None, None, None, "issue", "Team", 9.5, None, "r", 7, "open"),
        (None, None, "f", "v", None, None, None, None, None, None, None),
    ]
    got = sorted(tuple(r) for r in evidence.stated_facts(spark.createDataFrame(rows, kind)).collect())
    assert got == [("a", "Default", "seats", " 5 "), ("a", "default", "seats", "6"), ("a", "default", "tier", "Pro"), ("b", "Team", "currency", "USD"), ("b", "Team", "price_value", "9.5"), ("c", "r#7", "github_state", "open")]


def test_case_violations(spark):
    nan = float("nan")
    rows = [("fine", ["a"], ["lang"], {"a": 1.0}), ("plain", ["a"], None, None), ("twice", ["a"], [], None), ("twice", ["a"], [], None), ("empty", [], ["hue"], None), ("null", None, None, None), ("nan", ["a"], None, {"a": nan}), ("low", ["a", "b"], None, {"a": 2.0, "b": 0.0, "c": -1.0})]
    cases = spark.createDataFrame(rows, "case_id string, relevant array<string>, filters array<string>, grades map<string,double>")
    got = sorted(tuple(r) for r in evaluate.case_violations(cases, ["lang"]).collect())
    assert got == [("empty", "no_relevant"), ("empty", "unknown_filter"), ("low", "bad_grade"), ("low", "relevant_without_grade"), ("nan", "bad_grade"), ("null", "no_relevant"), ("twice", "duplicate_case")]
    assert [tuple(r) for r in evaluate.case_violations(cases.limit(0), ["lang"]).collect()] == [(None, "no_cases")]


def test_cards(spark):
    cards = spark.createDataFrame([(1, "Acme", "E1", 0.8, 80, False, False), (2, "acme ", "E1", 0.5, 80, False, False), (3, "acme", "E1", 0.9, 50, False, False), (4, "acme", "E1", 0.9, 50, True, False), (5, "acme", "E1", 0.3, 39, False, True)], "card_id int, competitor string, event_type string, confidence double, priority int, has_conflicts boolean, review_required boolean")
    ev = spark.createDataFrame([(1, "a", "ACME", None), (2, "a", "other", "E2"), (2, "a", "other", "E2"), (4, "d", "acme", "E1"), (9, "z", "acme", "E1")], "card_id int, chunk_id string, competitor string, event_type string")
    ci = spark.createDataFrame([(1, "finding", ["a"]), (2, "finding", ["b"]), (4, "impact", []), (3, "finding", []), (9, "impact", ["q"])], "card_id int, kind string, chunk_ids array<string>")
    got = sorted(tuple(r) for r in scoring.card_violations(cards, ev, ci).collect())
    assert got == [(2, "foreign_event"), (2, "foreign_product"), (2, "review_missing"), (2, "unknown_chunk_finding"), (3, "cap_exceeded"), (3, "review_missing"), (4, "review_missing"), (4, "uncited_impact")]
    capped = scoring.cap_cards(cards, ev)
    assert {r.card_id: (r.confidence, r.priority, r.review_required) for r in capped.collect()} == {1: (0.8, 80, False), 2: (0.5, 80, True), 3: (0.3, 39, True), 4: (0.9, 50, True), 5: (0.3, 39, True)}
    assert not {"review_missing", "cap_exceeded"} & {r.violation for r in scoring.card_violations(capped, ev, ci).collect()}


def test_cohorts(spark):
    kind = "cohort int, product string, version string, window_days int, snapshot_date date"
    d = lambda n: datetime.date(2024, 1, n)
    cur = spark.createDataFrame([(1, "Base", "v1", 90, d(9)), (1, "Other", "v1", 90, d(9)), (2, "Other", "v1", 90, d(9)), (2, " other", "v2", 30, d(9))], kind)
    prev = spark.createDataFrame([(1, "base", "v1", 90, d(8)), (1, "other", "v0", 90, d(10)), (1, "new", "v1", 90, d(1)), (1, "BASE", "v1", 90, d(7))], kind)
    got = sorted(tuple(r) for r in scoring.cohort_violations(cur, "base", prev).collect())
    assert got == [(1, "many_previous", "base", 2), (1, "previous_later", "other", 1), (1, "previous_unknown", "new", 1), (1, "previous_version", "other", 1), (2, "many_snapshots", "other", 2), (2, "mixed_version", "version", 2), (2, "mixed_window", "window_days", 2), (2, "no_baseline", "base", 2)]
