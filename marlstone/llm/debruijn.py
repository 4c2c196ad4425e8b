"""Substring removal over words by De Bruijn compaction.

Edges of the graph are token windows; runs of windows with one minimiser (see
repeats) are its paths' atoms.  Repeated atoms that follow each other in one way only
are joined into nonbranching paths through Spark joins, and each path's source
coordinates give the long repeated spans, once the words there are found to be the
same.  Where paths branch, single windows (edges) are counted by their hashes and
checked in the same way.

Defined cases: a null text has no words; a text shorter than a window loses nothing;
repeated rows are occurrences of their own and lose what they share; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats, shared, textkit

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


def compact(atoms: DataFrame, window: int) -> DataFrame:
    """Nonbranching paths: rid, s, e (words), atoms (piece, a, m).  atoms: rid, piece, a, m."""
    order = Window.partitionBy("rid").orderBy("a")
    r = atoms.select("rid", "piece", "a", "m").withColumn("_next", F.when(F.lead("a").over(order) == F.col("a") + F.col("m"), F.lead("piece").over(order)))
    links = r.where(F.col("_next").isNotNull()).select("piece", "_next").distinct()
    single = lambda c: links.groupBy(c).agg(F.count("*").alias("_d")).where("_d = 1").select(c)
    plain = links.join(single("piece"), "piece").join(single("_next"), "_next").select(F.col("piece").alias("_p"), F.col("_next").alias("_q"))
    r = r.join(plain, (F.col("piece") == F.col("_p")) & (F.col("_next") == F.col("_q")), "left").withColumn("_on", F.col("_p").isNotNull()).drop("_p", "_q", "_next")
    r = r.withColumn("_run", F.sum(F.when(F.lag("_on").over(order), 0).otherwise(1)).over(order))
    return r.groupBy("rid", "_run").agg(F.min("a").alias("s"), (F.max(F.col("a") + F.col("m")) - 1 + window).alias("e"), F.collect_list(F.struct("piece", "a", "m")).alias("atoms")).drop("_run")


def paths_by_row(atoms: DataFrame, window: int) -> DataFrame:
    """rid and the array of its nonbranching paths (s, e, atoms), written."""
    return shared.cut(compact(atoms, window).groupBy("rid").agg(F.collect_list(F.struct("s", "e", "atoms")).alias("paths")), "paths")


def repeated_edges(d: DataFrame, unit: str, window: int, open_: DataFrame) -> DataFrame:
    """Windows of unlike pieces whose hash occurs twice, one by one: rid, s, e, key (hash), own.  open_: rid, a, m, whole.

    own windows are those of pieces that do not repeat as a whole.  A repeated row gives
    its windows twice, as they do repeat.
    """
    per = open_.groupBy("rid").agg(F.collect_list(F.struct("a", "m", "whole")).alias("spots"))
    texts = repeats.dealt(d, repeats.sieve(open_)).select("rid", "text").join(per, "rid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, spots = np.asarray(b.column("rid")), b.column("spots").to_pylist()
            for s in textkit.slices(b.column("text")):
                spans, off, _ = repeats.units(s, unit)
                for i in range(s.rows):
                    x = spots[s.first + i]
                    a, m = np.asarray([y["a"] for y in x], np.int64), np.asarray([y["m"] for y in x], np.int64)
                    at = textkit.ranges(a, m)
                    own = np.repeat(np.asarray([not y["whole"] for y in x], bool), m)
                    h = spans.hash(at + off[i], at + off[i] + window).view(np.int64)
                    yield pa.record_batch([pa.array(h), pa.array(np.full(len(at), rid[s.first + i])), pa.array(at), pa.array(own)], names=["key", "rid", "s", "own"])

    edges = shared.cut(texts.select("rid", "text", "spots").mapInArrow(work, "key long, rid long, s long, own boolean"), "edges")
    twice = shared.cut(edges.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "twice")
    out = shared.cut(edges.join(twice, "key").select("rid", "s", (F.col("s") + window).alias("e"), "key", "own"), "spots")
    shared.drop(edges, twice)
    return out


def contents(d: DataFrame, spots: DataFrame, unit: str = "words") -> DataFrame:
    """rid, s, e, key, own and a digest (d1, d2) of the very words (or bytes) at each spot's source coordinates.

    spots: rid and an array of (key, s, e, own), a written table.
    """
    texts = repeats.dealt(d, repeats.sieve(spots)).select("rid", "text").join(spots, "rid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("spots")
            off = np.asarray(at.offsets)
            cols = [at.values.field(c).slice(off[0], off[-1] - off[0]) for c in ("s", "e", "key", "own")]
            s, e = np.asarray(cols[0]), np.asarray(cols[1])
            off = off - off[0]
            raw = bytearray()
            for i, t in enumerate(b.column("text")):
                own = t.as_py().encode()
                words = own.split() if unit == "words" else None
                for j in range(off[i], off[i + 1]):
                    raw += hashlib.blake2b(own[s[j] : e[j]] if words is None else b" ".join(words[s[j] : e[j]]), digest_size=16).digest()
            two = np.frombuffer(raw, "<i8").reshape(-1, 2)
            rid = np.repeat(np.asarray(b.column("rid")), np.diff(off))
            yield pa.record_batch([pa.array(rid), *cols, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["rid", "s", "e", "key", "own", "d1", "d2"])

    return texts.select("rid", "text", "spots").mapInArrow(work, "rid long, s long, e long, key long, own boolean, d1 long, d2 long")


def unlike(seen: DataFrame) -> DataFrame:
    """Keys whose spots do not all hold the same words (their hashes met by chance), written; hardly ever any."""
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)]
    return shared.cut(seen.groupBy("key").agg(*ends).where("_min_d1 <> _max_d1 or _min_d2 <> _max_d2").select("key"), "unlike")


def verified(d: DataFrame, spots: DataFrame, unit: str = "words") -> DataFrame:
    """Own spots (rid, s, e) whose words (or bytes) occur at another spot of their key; spots: rid, s, e, key, own, a written table."""
    per = shared.cut(spots.groupBy("rid").agg(F.collect_list(F.struct("key", "s", "e", "own")).alias("spots")), "lists")
    odd = unlike(contents(d, per, unit))
    own = spots.where("own").select("rid", "s", "e")
    if not odd.isEmpty():
        mixed = contents(d, per, unit).join(odd, "key", "left_semi")
        real = mixed.groupBy("key", "d1", "d2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        own = spots.where("own").join(odd, "key", "left_anti").select("rid", "s", "e").unionByName(mixed.where("own").join(real, ["key", "d1", "d2"]).select("rid", "s", "e"))
    else:
        shared.drop(per, odd)
    return own


def word_digest(b: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    n, out = b.num_rows, {"w": [], "r": [], "k": [], "h": []}
    for t, own in zip(b.column("text").to_pylist(), spans):
        words = t.encode().split()
        gone = repeats.cover(len(words), own) if own else None
        if gone is not None:
            kept = [w for w, g in zip(words, gone) if not g]
            out["k"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
        else:
            kept = words
            out["k"].append(0)
        out["w"].append(len(words))
        out["r"].append(len(words) - len(kept))
        out["h"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    assert len(out["w"]) == n
    return pa.record_batch([b.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in "wrk"), pa.array(out["h"], pa.string())], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(d: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """rid, s, e of repeated spans in words (they may overlap).

    Atoms are found by hashes; the words at the paths' source coordinates are then held
    against each other, and atoms with one hash and unlike words are taken apart into
    windows, which are checked in the same way.
    """
    f = repeats.flagged(d, "words", window, k)
    paths, open_ = paths_by_row(f.where("whole"), window), f.where("probe").select("rid", "a", "m", "whole")
    atom = lambda x: F.struct(x["piece"].alias("key"), x["a"].alias("s"), (x["a"] + x["m"] - 1 + window).alias("e"), F.lit(True).alias("own"))
    odd = unlike(contents(d, paths.select("rid", F.transform(F.flatten(F.col("paths.atoms")), atom).alias("spots"))))
    if not odd.isEmpty():
        odd = odd.withColumnRenamed("key", "piece")
        paths, open_ = paths_by_row(f.where("whole").join(odd, "piece", "left_anti"), window), taken_apart(f, odd)
    spans = paths.select("rid", F.explode("paths").alias("_p")).select("rid", "_p.s", "_p.e")
    return spans.unionByName(verified(d, repeated_edges(d, "words", window, open_)))


def taken_apart(f: DataFrame, odd: DataFrame) -> DataFrame:
    """Probes (rid, a, m, whole) of flagged pieces where those in `odd` count as unlike all others."""
    near = f.join(odd, "piece", "left_semi").select("gram").distinct()
    apart = f.join(near, "gram", "left_semi").join(odd.withColumn("_odd", F.lit(True)), "piece", "left")
    rest = f.where("probe").join(near, "gram", "left_anti").select("rid", "a", "m", "whole")
    return rest.unionByName(apart.select("rid", "a", "m", (F.col("whole") & F.col("_odd").isNull()).alias("whole")))


def remove(docs: DataFrame, window: int = 35, k: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words covered by a window that starts anywhere else go; one row for each row of docs."""
    d = repeats.rows(docs, id_col, text_col)
    return repeats.finish(d, repeated_spans(d, window, k), RESULT, word_digest)
