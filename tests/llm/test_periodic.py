"""Periodic runs against a plain search for every period."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, times=4, least=6):
    """Every (start, length, period), by comparing words at every distance."""
    n, spans = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                spans.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in spans.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    if w:
        order = queries.read_periodically(doc_id, len(w))
        w = w if order is None else [w[i] for i in order]
    runs = plain_runs(w)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = None
    for s, z, q in runs:
        if best is None or z * best[2] > best[1] * q:
            best = (s, z, q)
    lines = "".join(f"{s},{z},{q}\n" for s, z, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_find_on_few_letters(rows):
    flat = np.asarray([x + 3 * i for i, r in enumerate(rows) for x in r], np.int64)
    end = np.asarray([e for e, r in zip(np.cumsum([len(r) for r in rows]), rows) for _ in r], np.int64)
    want, at = [], 0
    for r in rows:
        want += [(s + at, z, q) for s, z, q in plain_runs(r)]
        at += len(r)
    assert list(zip(*map(np.ndarray.tolist, periodic.find(flat, end)))) == want


def test_nested_and_long_runs():
    inner = [0] * 6 + [1]
    w = (inner * 9 + [2]) * 7 + [3] + [4, 5] * 500
    got = periodic.find(np.asarray(w, np.int64), np.full(len(w), len(w)))
    assert list(zip(*map(np.ndarray.tolist, got))) == plain_runs(w)
    with pytest.raises(ValueError):
        periodic.find(np.zeros(3, np.int64), np.full(3, 3), times=2)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    text = lambda n, v: r.choice([" ", "\n", "\t "]).join(r.choice(v) for _ in range(n))
    rows = [(i, text(r.randint(0, 120), "aé" if i % 3 else ["x", "yy", "ß", "zz."])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 1500), (204, "one two " * 900 + "end"), (None, "b b b b b b b"), (203, "a " * 1500), (206, "a\x1cb\x85c " * 9), (207, text(3000, "ab"))]
    # runs, best and row clash with names that the operator uses itself
    return spark.createDataFrame([(*x, 7, "r", 1) for x in rows], "doc_id long, text string, runs int, best string, row int")


def test_query_matches_brute_force(docs):
    got = sorted(map(tuple, periodic.digest(periodic.detect(docs, reorder=queries.read_periodically)).collect()), key=repr)
    want = sorted((plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want
    assert sum(x[1] > 0 for x in want) > 40


def test_empty_and_columns(docs):
    out = periodic.digest(periodic.detect(docs.where("false")))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.count() == 0


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    short = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 9000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    for doc_id, text in short.items():
        assert got[doc_id] == plain_row(doc_id, text)
