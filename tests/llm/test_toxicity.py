"""Toxicity scores: held-out rows, swapped group terms, chosen n-grams against plain counts, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import queries, textkit, toxicity

FILL = "the quiet river runs past old mills and green fields where people walk talk work rest every single day".split()
BAD = ["vexlor", "vexlmin", "grubtak", "grubtok"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def make(n=600, mention=0.0, seed=5):
    """Rows (doc_id, text) and labels; toxic texts hold two bad words, and with `mention` most of them name one group."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = [r.choice(FILL) for _ in range(r.randint(5, 60))]
        toxic = i % 5 < 2
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "en", "s"]))
            if r.random() < mention:
                w.insert(r.randrange(len(w)), "muslims")
        elif r.random() < mention / 20:
            w.insert(r.randrange(len(w)), "christians")
        rows.append((i, " ".join(w).capitalize() + "."))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def frames(spark, rows, marks):
    # label, text and features clash with names that the operator uses itself
    docs = spark.createDataFrame([(*x, 3, "f", 1.0) for x in rows], "doc_id long, text string, label int, features string, score double")
    return docs, spark.createDataFrame([(*x, "t") for x in marks], "doc_id long, quality int, toxic int, text string")


def test_held_out_rows(spark):
    rows, marks = make()
    docs, labels = frames(spark, rows, marks)
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert {i: r.held_out for i, r in got.items()} == {i: held_out(i) for i, _ in rows}
    out = [i for i, _ in rows if held_out(i)]
    assert sum(got[i].predicted == marks[i][2] for i in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # labels of held-out rows teach nothing
    turned = spark.createDataFrame([(i, q, 1 - t if held_out(i) else t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.judge(docs, turned).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)


def test_neutral_mentions_are_spared(spark):
    """Toxic texts name one group; the penalty lowers the scores of clean texts that name it, and swaps change scores less."""
    rows, marks = make(900, mention=0.9)
    docs, labels = frames(spark, rows, marks)
    r = random.Random(9)
    neutral = [(5000 + i, " ".join([r.choice(FILL) for _ in range(8)] + ["muslims", "and"] + [r.choice(FILL) for _ in range(8)])) for i in range(60)]
    swapped = [(1000 + i, t.replace("muslims", "buddhists")) for i, t in neutral]
    new, _ = frames(spark, neutral + swapped, [(0, 0, 0)])

    def scores(penalty):
        d = docs.select("doc_id", "text")
        model = toxicity.learn(d, labels.selectExpr("doc_id", "toxic as label"), penalty=penalty)
        got = {x.doc_id: x.score for x in toxicity.predict(new.select("doc_id", "text"), model).collect()}
        a = np.asarray([got[5000 + i] for i in range(60)])
        return a, np.abs(a - np.asarray([got[6000 + i] for i in range(60)]))

    plain, plain_change = scores(0.0)
    fair, fair_change = scores(5.0)
    assert fair.mean() < plain.mean() and fair_change.mean() < 0.3 * plain_change.mean()
    assert (fair >= 0.5).mean() <= (plain >= 0.5).mean() and (fair < 0.5).all()


def test_counts_and_choice_against_plain_ones(spark):
    rows, marks = make(120)
    picked = spark.createDataFrame([(i, t.lower(), marks[i][2]) for i, t in rows], "doc_id long, text string, label int")

    def plain(text):
        out = set()
        for w in text.lower().split():
            m = b"\x01" + w.encode() + b"\x02"
            out |= {m[i : i + k] for k in range(3, 7) for i in range(len(m) - k + 1)} | ({m} if len(m) > 6 else set())
        return out

    want: dict = {}
    for i, t in rows:
        for g in plain(t):
            want.setdefault(g, [0, 0])[1 - marks[i][2]] += 1
    got = sorted((r.toxic, r.clean) for r in toxicity.count_grams(picked).collect())
    assert got == sorted(map(tuple, want.values()))
    features = toxicity.Features(toxicity.choose(toxicity.count_grams(picked), 48, 72, 50))
    assert 0 < len(features) <= 50
    s = next(textkit.slices(pa.array([t.lower() for _, t in rows])))
    row, f = features.of_rows(s)
    seen: dict = {}
    for i, k in zip(row.tolist(), f.tolist()):
        seen.setdefault(k, set()).add(i)
    # every chosen n-gram is in the rows that hold it, and in no others
    by_rows = {frozenset(i for i, t in rows if g in plain(t)) for g in want}
    assert all(frozenset(x) in by_rows for x in seen.values())


def test_swaps():
    groups = [["women", "men"], ["black", "white", "brown"]]
    got = list(toxicity.swaps("women talk. black mills and women! the end", groups, 2))
    assert got[0] == ("women talk", "men talk")
    assert {b for a, b in got if a.startswith(" black")} == {" white mills and men", " brown mills and men"}
    assert not list(toxicity.swaps("nobody is named", groups)) and not list(toxicity.swaps("women", []))


def test_odd_tables(spark):
    rows, marks = make(200)
    docs, labels = frames(spark, [*rows, (900, None), (901, ""), (None, "vexlor the grubtak"), (902, "vexlor " * 50000), (0, rows[0][1])], [*marks, (None, 1, 1), (7, 0, None), (3, 0, 1), (12345, 0, 1)])
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 205
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[None].predicted == 1 and by[902].predicted == 1
    assert by[900].score == by[901].score and by[901].predicted == 0
    assert toxicity.judge(docs.where("false"), labels).count() == 0
    assert {(r.score, r.predicted) for r in toxicity.judge(docs, labels.where("false")).collect()} == {(0.0, 0)}
    one = {r.predicted for r in toxicity.judge(docs, labels.where("toxic = 0")).collect()}
    assert one == {0}


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op12_counterfactual_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [i for i in labels if held_out(i)]
    assert sum(got[i].predicted == labels[i] for i in out) >= 0.95 * len(out)
