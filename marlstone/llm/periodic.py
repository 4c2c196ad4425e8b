"""Runs of repeated words, found with a dictionary of basic factors.

For every power of two m, each position gets a name for the m words that begin there:
the pair of names of its halves, so that equal names mean equal words.  The successor of
a position is the next one in the text with its name.  Where a run of period q holds a
factor of m >= q words, that factor's successor is exactly q words on (a nearer one would
give the run a shorter period), so positions with successors at a like distance form
arithmetic progressions whose difference is the period.  A stretch of neighbouring
positions with one difference q is then extended to the whole run by the last factor and
its successor: count + q + m - 1 words.

A period is read at the one level with m/2 < q <= m, well within twice the length m, which
finds every run of three periods or more once: nothing has to be merged afterwards.
Positions whose factor occurs once in their text leave after each level.

Words are compared as words, not by hash.  Texts are independent of each other, so nothing
is shuffled; memory is about 100 bytes for each word of a slice of texts, or of the
longest text where that is larger than a slice.

Defined cases: a null text, an empty one and one without words have no run and an empty
collapsed text; repeated rows are judged alike; a null id is a row like any other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(word: np.ndarray, end: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of every run with length >= max(least, times * period), by start and period.

    word: a number for each position, equal for equal words of one text and for no others;
    end: the end of the position's text.  times must be 3 at least.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found at one level")
    n, m = len(word), 1
    pos, key = np.arange(n), word
    found = []
    while len(pos) > 1:
        order = np.argsort(key, kind="stable")
        p, same = pos[order], np.diff(key[order]) == 0
        away = np.diff(p)
        gap = np.zeros(n + 1, np.int64)
        near = same & (away <= m) & (away > m // 2)
        gap[p[:-1][near]] = away[near]
        edge = np.flatnonzero(np.diff(gap, prepend=0))
        q = gap[edge[:-1]]
        length = np.diff(edge) + q + m - 1
        keep = (q > 0) & (length >= np.maximum(least, times * q))
        found.append((edge[:-1][keep], length[keep], q[keep]))
        # factors that occur twice at least, and their pairs
        again = np.append(False, same) | np.append(same, False)
        name = np.full(n, -1)
        name[p[again]] = np.cumsum(np.append(False, ~same))[again]
        pos = np.flatnonzero((name >= 0) & (np.arange(n) + 2 * m <= end))
        pos = pos[name[pos + m] >= 0]
        key, m = name[pos] * n + name[pos + m], 2 * m
    s, z, q = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((q, s))
    return s[order], z[order], q[order]


def _best(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run of greatest length / period; of equal ones the first, then that of the shorter period."""
    top = None
    for s, z, q in runs:
        if top is None or z * top[2] > top[1] * q:
            top = (s, z, q)
    return None if top is None else dict(zip(("start", "length", "period"), top))


def _sequences(s: textkit.Slice, ids: list, reorder: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts as they are to be read: its place in the slice; and where texts begin."""
    count = np.diff(s.word_off)
    at = np.arange(len(s.start))
    if reorder is not None:
        for i in np.flatnonzero(count).tolist():
            own = reorder(ids[s.first + i], int(count[i]))
            if own is not None:
                at[s.word_off[i] : s.word_off[i + 1]] = s.word_off[i] + own
    return at, s.word_off


def detect(docs: DataFrame, times: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text", reorder: Callable | None = None) -> DataFrame:
    """doc_id, runs (by start, then period), best (the run of greatest length / period), collapsed.

    A run is a stretch of words with smallest period q, at least `times` * q and `least`
    words long, that no neighbouring word extends.  collapsed has the text's words joined
    by single spaces, without those that any run holds beyond its first q words.
    `reorder(id, n)` may give the places of the words of a text in the order in which they
    are to be read, or None to read them as they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist() if reorder is not None else []
            for s in textkit.slices(b.column(1)):
                s.words()
                at, off = _sequences(s, ids, reorder)
                size = s.end - s.start
                each, names, _ = s.distinct()
                word = each[at] + s.row * len(names)
                first, length, period = find(word, off[1:][s.row], times, least)
                edge = np.zeros(len(at) + 1, np.int64)
                np.add.at(edge, first + period, 1)
                np.add.at(edge, first + length, -1)
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                # words and the spaces between them, gathered at once
                row, source = s.row[kept], at[kept]
                gap = np.append(row[1:] == row[:-1], False)[: len(kept)]
                take = size[source] + gap
                padded = np.append(s.data, np.uint8(0x20))
                out = padded[textkit.ranges(s.start[source], take)]
                stop = np.cumsum(take)
                out[stop[gap] - 1] = 0x20
                text_off = np.append(0, stop)[np.searchsorted(row, np.arange(s.rows + 1))].astype(np.int32)
                text = pa.StringArray.from_buffers(s.rows, pa.py_buffer(text_off), pa.py_buffer(np.ascontiguousarray(out)))
                own = s.row[first]
                cuts = np.searchsorted(own, np.arange(s.rows + 1)).astype(np.int32)
                local = first - off[own]
                runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], fields=list(_RUN)))
                three = list(zip(local.tolist(), length.tolist(), period.tolist()))
                best = pa.array([_best(three[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], _RUN)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), runs, best, text], names=["doc_id", "runs", "best", "collapsed"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(work, f"doc_id {dict(d.dtypes)['doc_id']}, runs array<{RUN}>, best {RUN}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run and its exponent in thousandths, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
