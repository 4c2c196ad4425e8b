"""Filters by signature, statistics over filtered sets, and keywords by automaton, against plain loops."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import keywords
from marlstone.functions import text as X
from marlstone.operators import filters, retrieval, tables

LISTS = {"any_source": "source", "any_tag": "tags"}


def rows(seed=2, n=80, q=60):
    r = random.Random(seed)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    some = lambda pool, k: [r.choice(pool) for _ in range(r.randint(0, k))]
    chunks = [(i, r.choice(["Blog", "docs", "FORUM", None]), r.choice([None, some(["a", "B", "c", "a", None], 4)]), r.choice([True, False, None]), r.choice([None, day(r.randint(0, 20))]), " ".join(some(["red", "fox", "ran", "far"], 9))) for i in range(n)]
    asked = [(i, r.choice([None, some(["BLOG", "docs", "x"], 3)]), some(["A", "b", "C"], 3), r.choice([True, False, None]), r.choice([None, None, day(5)]), r.choice([None, None, day(12)]), " ".join(some(["red", "fox", "Fox", "lost"], 4))) for i in range(q)]
    return chunks, asked


def passes(c, q):
    low = lambda xs: {x.lower() for x in xs or [] if x is not None}
    if low(q[1]) and (c[1] or "").lower() not in low(q[1]):
        return False
    if low(q[2]) and not low(q[2]) & low(c[2]):
        return False
    if q[3] and not c[3]:
        return False
    return not (q[4] or q[5]) or (c[4] is not None and (q[4] is None or c[4] >= q[4]) and (q[5] is None or c[5 - 1] <= q[5]))


@pytest.fixture(scope="module")
def frames(spark):
    chunks, asked = rows()
    c = spark.createDataFrame(chunks, "id int, source string, tags array<string>, is_current boolean, published timestamp, body string")
    q = spark.createDataFrame(asked, "qid int, any_source array<string>, any_tag array<string>, current_only boolean, q_start timestamp, q_end timestamp, question string")
    return chunks, asked, c, q


def test_filter(frames):
    chunks, asked, c, q = frames
    got = filters.metadata_filter(c, q, "qid", LISTS)
    assert set(got.columns) == {"qid", *c.columns}
    assert sorted((r.qid, r.id) for r in got.collect()) == sorted((x[0], y[0]) for x in asked for y in chunks if passes(y, x))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert filters.signatures(q, "qid", LISTS)[1].count() < len(asked)
    assert filters.metadata_filter(c, q.where("false"), "qid", LISTS).count() == 0 and filters.metadata_filter(c.where("false"), q, "qid", LISTS).count() == 0


def test_statistics_of_the_filtered_set(spark, frames):
    import math

    chunks, asked, c, q = frames
    got = {}
    for r in retrieval.bm25_filtered(q, c, "qid", "question", "id", {"body": 1}, 5, LISTS).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    for x in asked:
        held = [y for y in chunks if passes(y, x)]
        words = x[6].lower().split()
        if not words:
            want = [(i + 1, y[0], None) for i, y in enumerate(sorted(held)[:5])]
        else:
            n, avg = len(held), sum(len(y[5].split()) for y in held) / max(len(held), 1)
            scored = []
            for y in held:
                own = y[5].split()
                s = 0.0
                for w in words:
                    df, tf = sum(w in z[5].split() for z in held), own.count(w)
                    if tf:
                        s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
                if round(s, 6) > 0:
                    scored.append((-round(s, 6), y[0]))
            want = [(i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:5])]
        assert [(a, b, None if s is None else pytest.approx(s, abs=2e-6)) for a, b, s in want] == sorted(got.get(x[0], [])), x


TERMS = ["cat", "cats", "price", "release note", "c++", "价格", "s", "box"]


def plain_hits(text):
    out = {}
    for t in TERMS:
        if re.search("[㐀-鿿]", t):
            at = text.find(t)
        else:
            m = re.search(r"(?:^|(?<=[^a-z0-9]))" + re.escape(t) + ("(?:s|es)?" if t[-1].isalnum() else "") + r"(?=[^a-z0-9]|$)", text)
            at = m.start() if m else -1
        if at >= 0:
            out[t] = at
    return out


def test_keywords(spark):
    r = random.Random(6)
    bits = ["cat", "cats", "cates", "price", "prices", "release note", "c++", "新价格表", "box", "boxes", "boxess", "x", " ", " ", "-", "é", "1", "s", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x.id: {h.term: h.at for h in x.h} for x in d.select("id", keywords.occurrences(F.col("t"), TERMS, tokens=True).alias("h")).collect()}
    assert got == {i: plain_hits(t or "") for i, t in enumerate(texts)}
    table = spark.createDataFrame([(t,) for t in [*TERMS, "", "CAT", None]], "name string")
    for most in (3, 100):
        found = keywords.occurring(d, "id", F.col("t"), table, "name", most)
        assert {(x.id, x.term, x.at) for x in found.collect()} == {(i, t, s.find(t)) for i, s in enumerate(texts) if s for t in TERMS if t in s}


def test_inferred_filters_and_synonyms(spark):
    q = spark.createDataFrame([(1, "Latest ACME Pro price in the last 2 weeks, v1.2.3?"), (2, "what is acme"), (3, None)], "id int, text string")
    a = spark.createDataFrame([("acme", "A"), ("Acme Pro", "AP")], "alias string, canonical string")
    e = spark.createDataFrame([(2, "Z", 9, True)], "id int, competitor string, days int, current boolean")
    got = {r.id: (list(r.kinds), list(r.versions or []), r.days, r.current, r.competitor) for r in tables.infer_filters(q, "id", "text", a, {"pricing": ["price", "cost"]}, e).collect() if r.id < 3}
    assert got == {1: (["pricing"], ["1.2.3"], 14, True, "AP"), 2: ([], [], 9, True, "Z")}
    s = spark.createDataFrame([("price", "cost", 1), ("price", "Fee", 2), ("acme", "the firm", 3), ("acme", "latest", 4)], "term string, synonym string, seq int")
    got = {r.id: (r.expanded, r.n_added) for r in tables.expand_queries(q.where("id < 3"), "id", "text", s).collect()}
    assert got == {1: ("Latest ACME Pro price in the last 2 weeks, v1.2.3? cost Fee the firm", 3), 2: ("what is acme the firm latest", 2)}


def test_pre_release_words(spark):
    for raw, want in (("v1.0 beta2", "1.0.0-beta2"), ("1.0 rc.1", "1.0.0-rc.1"), ("1.0 a1", "1.0.0-a1"), ("1.0 better", "1.0.0"), ("1.0 prefix", "1.0.0"), ("2 preview", "2.0.0-preview"), ("1.0-anything", "1.0.0-anything")):
        got = spark.createDataFrame([(raw,)], "x string").select(X.normal_version(F.col("x"))).first()[0]
        assert got == want, raw
