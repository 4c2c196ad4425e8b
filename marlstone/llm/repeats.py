"""Repeated windows of a fixed length across all texts: the part that substring operators share.

A window is `window` consecutive units (bytes or words) of one row.  Every window picks
the least-hashed of its k-unit grams, so equal windows pick equal grams.  Neighbouring
windows with the same pick form a piece.  Pieces whose gram occurs once cannot hold a
repeated window; pieces with equal contents repeat as a whole; what is left (unlike
pieces with a gram in common) is for the operator to resolve.

Only fixed-size rows (hashes and positions) are shuffled, texts move only for rows that
share a gram.  Rows are named by a 64-bit digest of id and text: repeated rows share a
name and a result, and count as separate occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textkit


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.withColumn("rid", F.xxhash64("doc_id", "text"))


def units(s: textkit.Slice, unit: str) -> tuple[textkit.Spans, np.ndarray, int]:
    """Range hashes over the slice's units, the rows' first units, and the number of units."""
    if unit == "bytes":
        return s.bytes_hash(), s.off, len(s.data)
    s.words()
    return textkit.Spans(s.h), s.word_off, len(s.h)


def pieces(d: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """rid, gram, piece (hash of the whole piece), a (first window), m (number of windows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = np.asarray(b.column(0))
            for s in textkit.slices(b.column(1), 1 << 17):
                spans, off, n = units(s, unit)
                if n < window:
                    continue
                gram = spans.every(k)
                pick = textkit.window_min(gram, window - k + 1)
                row = np.repeat(np.arange(s.rows), np.diff(off))
                starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
                if not len(starts):
                    continue
                pick = pick[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (np.diff(starts) != 1) | (pick[1:] != pick[:-1])
                first = np.flatnonzero(new)
                a, m = starts[first], np.diff(np.append(first, len(starts)))
                own = row[a]
                yield pa.record_batch(
                    [pa.array(rid[s.first + own]), pa.array(gram[pick[first]].view(np.int64)), pa.array(spans.hash(a, a + m - 1 + window).view(np.int64)), pa.array(a - off[own]), pa.array(m.astype(np.int32))],
                    names=["rid", "gram", "piece", "a", "m"],
                )

    return d.select("rid", "text").mapInArrow(work, "rid long, gram long, piece long, a long, m int")


def flagged(d: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """Pieces that share a gram: whole (its contents occur elsewhere too), probe, rivals.

    A piece that is not whole must be compared with the other contents of its gram;
    of equal pieces one occurrence (probe) stands for all there.  rivals counts the
    different contents of the gram.  Texts are cut once: the written pieces are counted
    and then looked up.
    """
    p = shared.cut(pieces(d, unit, window, k), "pieces")
    f = rivalry(p)
    shared.drop(p)
    return f


def rivalry(s: DataFrame) -> DataFrame:
    """Pieces (rid, gram, piece, a, m) that are whole or probes, with whole, probe and rivals.

    Counts are written before they are joined, so that both sides of every join are plain
    shuffles and a gram or a content with very many rows can be split between tasks.  The
    probe of equal pieces is that of the least hash, so that counting needs no sort.
    """
    name = F.xxhash64("rid", "a")
    counts = shared.cut(s.groupBy("gram", "piece").agg(F.count("*").alias("_n"), F.min(name).alias("_first")), "contents")
    per = counts.groupBy("gram").agg(F.count("*").alias("rivals"), F.max(F.col("_n") == 1).alias("_open")).where("rivals > 1 and _open").drop("_open")
    per = shared.cut(per, "rivals")
    own = shared.cut(counts.join(per, "gram", "left").where("_n > 1 or rivals is not null"), "judged")
    first = F.col("_first") == name
    whole = F.col("_n") > 1
    f = s.join(own, ["gram", "piece"])
    f = shared.cut(f.select("rid", "gram", "piece", "a", "m", F.coalesce("rivals", F.lit(1)).alias("rivals"), whole.alias("whole"), (F.col("rivals").isNotNull() & (~whole | first)).alias("probe")), "flagged")
    shared.drop(counts, per, own)
    return f


def split(d: DataFrame, heavy: DataFrame, unit: str, window: int, k: int, step: int) -> DataFrame:
    """Cuts pieces into smaller ones: at most `step` windows at like distances from the gram.

    Their gram is what all windows of the part have in common, nearly a whole window, so
    pieces that only share a short gram come apart, and equal parts repeat as a whole.
    """
    per = heavy.groupBy("rid").agg(F.collect_list(F.struct("gram", "a", "m")).alias("spots"))
    texts = dealt(d, sieve(heavy)).select("rid", "text").distinct().join(per, "rid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, spots = np.asarray(b.column("rid")), b.column("spots").to_pylist()
            for s in textkit.slices(b.column("text")):
                spans, off, _ = units(s, unit)
                for i in range(s.rows):
                    x = spots[s.first + i]
                    first, end, core = [], [], []
                    for y in x:
                        a = int(off[i]) + y["a"]
                        near = np.arange(a, a + window - k + 1)
                        pick = int(near[np.argmax(spans.hash(near, near + k).view(np.int64) == y["gram"])])
                        # distance pick - start falls from pick - a; parts end where it crosses a multiple of step
                        z = np.arange(a, a + y["m"])
                        part = (pick - z) // step
                        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        first.append(z[cut])
                        end.append(z[np.append(cut[1:], len(z)) - 1] + 1)
                        low = part[cut] * step
                        core.append(spans.hash(pick - low, pick - low - step + 1 + window))
                    f, e = np.concatenate(first), np.concatenate(end)
                    yield pa.record_batch([pa.array(np.full(len(f), rid[s.first + i])), pa.array(np.concatenate(core).view(np.int64)), pa.array(spans.hash(f, e - 1 + window).view(np.int64)), pa.array(f - off[i]), pa.array((e - f).astype(np.int32))], names=["rid", "gram", "piece", "a", "m"])

    return texts.select("rid", "text", "spots").mapInArrow(work, "rid long, gram long, piece long, a long, m int")


def sieve(ids: DataFrame) -> np.ndarray | None:
    """A bitmap, sized by the number of ids, that holds every rid of them, and others by chance; None if it would hold nearly all."""
    return shared.sieve(ids, "rid")


def sift(d: DataFrame, bitmap: np.ndarray | None, schema: str, rest: Callable | None = None) -> DataFrame:
    """Rows of d that the sieve holds; or with `rest` what it makes of the slices of the others."""
    held = d.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = np.ones(b.num_rows, bool) if held.value is None else shared.within(held.value, np.asarray(b.column("rid")))
            if rest is None:
                yield b.filter(pa.array(inside))
            elif not inside.all():
                yield from map(rest, portions(b.filter(pa.array(~inside))))

    return d.mapInArrow(work, schema)


def dealt(d: DataFrame, bitmap: np.ndarray | None) -> DataFrame:
    """Rows of d that the sieve holds, dealt by rid: a join by rid needs no other exchange, and where it is broadcast no task runs one Python worker behind another."""
    return sift(d, bitmap, "doc_id long, text string, rid long").repartition("rid")


def portions(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in portions of so many rows, so that what Python makes of their texts stays small."""
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def cover(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n units lie in one of the [start, end) spans."""
    edge = np.zeros(n + 1, np.int32)
    if len(spans):
        s, e = np.asarray(spans, np.int64).T
        np.add.at(edge, s, 1)
        np.add.at(edge, e, -1)
    return np.cumsum(edge[:n]) > 0


def spans_by_row(spans: DataFrame) -> DataFrame:
    """rid and its array of (s, e) from rows (rid, s, e)."""
    return spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def finish(d: DataFrame, spans: DataFrame, schema: str, digest: Callable) -> DataFrame:
    """Results of all rows: digest(batch, spans or None) makes a record batch of `schema`."""
    per = shared.cut(spans_by_row(spans), "spans")
    bitmap = sieve(per)
    clean = sift(d, bitmap, schema, lambda b: digest(b, [None] * b.num_rows))
    held = dealt(d, bitmap).join(per, "rid", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in portions(whole)):
            own = [None if x is None else [(y["s"], y["e"]) for y in x] for x in b.column("spans").to_pylist()]
            yield digest(b, own)

    return clean.unionByName(held.select("doc_id", "text", "rid", "spans").mapInArrow(work, schema))
