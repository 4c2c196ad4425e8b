"""Work of the suffix arrays and of the search for pieces that repeat."""

import builtins

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import repeats, suffixes, textkit


def test_only_suffixes_that_are_wanted_or_induce_one_are_sorted(monkeypatch):
    r = np.random.Generator(np.random.PCG64(7))
    for _ in range(300):
        t = r.integers(97, 97 + r.integers(1, 5), r.integers(0, 60)).astype(np.uint8)
        raw, wanted = t.tobytes(), r.random(len(t)) < r.random()
        assert suffixes.two_stage(t, 64, wanted).tolist() == [i for i in sorted(range(len(raw)), key=lambda i: raw[i:]) if wanted[i]]
    t = r.integers(1, 200, 20_000).astype(np.uint8)
    wanted = np.arange(len(t)) % 1000 < 100
    taken = []
    monkeypatch.setattr(suffixes, "sorted", lambda x, key: taken.append(len(x)) or builtins.sorted(x, key=key), raising=False)
    suffixes.two_stage(t, 400, wanted)
    assert sum(taken) < 1500  # about half of 2,000, where all together are 10,000


def test_texts_are_cut_into_pieces_once(spark, monkeypatch):
    """Pieces are counted and looked up from one written table."""
    seen = spark.sparkContext.accumulator(0)
    cut = repeats.pieces

    def counted(d, *more):
        def look(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return cut(d.select("rid", "text").mapInArrow(look, "rid long, text string"), *more)

    monkeypatch.setattr(repeats, "pieces", counted)
    d = repeats.rows(spark.createDataFrame([(i, f"{i % 3} some words of text {i % 5} " * 30) for i in range(40)], "doc_id long, text string"))
    assert repeats.flagged(d, "bytes", 60, 16).count() > 0
    assert seen.value == 40


def test_every_stretch_has_the_hash_of_its_range():
    r = np.random.Generator(np.random.PCG64(9))
    spans = textkit.Spans(r.integers(0, 1 << 63, 500).astype(np.uint64))
    for k in (1, 12, 32, 500):
        at = np.arange(500 - k + 1)
        assert (spans.every(k) == spans.hash(at, at + k)).all()


def test_texts_meet_their_spans_in_one_exchange(spark):
    """Even where the spans are few and the join is broadcast, the texts come from an exchange, not from a worker of the same task."""
    d = repeats.rows(spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string"))
    spans = d.where("doc_id < 2").select("rid", F.lit(0).cast("long").alias("s"), F.lit(4).cast("long").alias("e"))
    got = repeats.finish(d, spans, suffixes.RESULT, suffixes.byte_digest)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    nodes = [x for x in plan if "MapInArrow" in x or "Exchange hashpartitioning(rid" in x]
    python = [i for i, x in enumerate(nodes) if "MapInArrow" in x]
    assert len(python) == 3 and any("Exchange" in x for x in nodes[python[1] : python[2]])
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(i, 4 if i < 2 else 0) for i in range(9)]
