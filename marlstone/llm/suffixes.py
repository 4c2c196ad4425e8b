"""Substring removal over bytes by suffix arrays, built in two stages.

Stage one sorts only the suffixes that are smaller than their successors; stage two
scans the buckets of first bytes in order and induces every other suffix from its
successor's place.  Common prefixes of adjacent suffixes are computed, and those of the
window's length mark repeats.  Spark deals the text that can repeat (see repeats) to small
arrays by common gram, so that no array grows with the table.  Pieces with equal contents
are grouped by their 64-bit hash before, and their bytes are held against each other by
128-bit digests: one of them stands for all in the arrays, and where nothing else shares
its gram none is needed.  A gram with very many unlike contents is cut into parts with
nearly a whole window in common; the windows of parts that are as crowded still are
grouped by hash, which spreads them over all tasks, and compared in the same way.

Defined cases: a null text is empty; a text shorter than the window loses nothing;
repeated rows are occurrences of their own and lose what they share; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import debruijn, repeats, shared, textkit

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def two_stage(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of t, in order of the first `depth` bytes at least; of the wanted suffixes only, if a mask says which.

    Besides those, only suffixes that induce them are put in order: from a wanted one
    on up to the next suffix that is smaller than its successor.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    wide = t.astype(np.int16)
    step = np.sign(np.diff(wide))
    # a suffix is smaller than its successor if the next change of byte goes up
    change = np.flatnonzero(step)
    small = np.zeros(n, bool)
    if len(change):
        small[: change[-1] + 1] = np.repeat(step[change] > 0, np.diff(change, prepend=-1))
    used = np.ones(n, bool)
    if wanted is not None:
        at = np.arange(n)
        stop = np.append(-1, np.maximum.accumulate(np.where(small, at, -1))[:-1])  # the last small suffix before each
        used = np.maximum.accumulate(np.where(wanted, at, -1)) > stop
    induced = used & ~small
    raw = t.tobytes()
    # sorted bucket by bucket of first bytes, so that only one bucket's keys are held at a time
    direct = np.flatnonzero(small & used)
    direct = direct[np.argsort(t[direct], kind="stable")]
    cuts = np.searchsorted(t[direct], np.arange(257))
    for c in np.flatnonzero(np.diff(cuts) > 1).tolist():
        direct[cuts[c] : cuts[c + 1]] = sorted(direct[cuts[c] : cuts[c + 1]].tolist(), key=lambda i: raw[i : i + depth])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if used[n - 1]:
        waiting[t[n - 1]].append(np.asarray([n - 1], np.int64))
    out = []
    for c in range(256):
        here = waiting[c]
        now = np.concatenate(here) if here else np.zeros(0, np.int64)
        while len(now):  # suffixes of this bucket that induce others of the same bucket
            before = now[now > 0] - 1
            now = before[(t[before] == c) & induced[before]]
            if len(now):
                here.append(now)
        here.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(here)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (t[before] > c)]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edge = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for i, j in zip(edge, np.append(edge[1:], len(before))):
                waiting[first[i]].append(before[i:j])
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    return sa if wanted is None else sa[wanted[sa]]


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each two neighbours of a suffix array, up to `most`; t is followed by nothing.

    Lengths are found by hashes of stretches that halve down to one byte; those of `most`
    bytes are held against each other whole.
    """
    x, y = sa[:-1], sa[1:]
    limit = np.minimum(len(t) - np.maximum(x, y), most)
    out, spans = np.zeros(len(x), np.int64), textkit.Spans(textkit._BYTE[t])
    for step in (1 << k for k in range(most.bit_length() - 1, -1, -1)):
        room = np.flatnonzero(out + step <= limit)
        p, q = x[room] + out[room], y[room] + out[room]
        out[room] += step * spans.same(p, q, step)
    raw, full = t.tobytes(), np.flatnonzero(out == most)
    for i, p, q in zip(full.tolist(), x[full].tolist(), y[full].tolist()):
        if raw[p : p + most] != raw[q : q + most]:  # a chance agreement of hashes
            out[i] = next(k for k in range(most) if raw[p + k] != raw[q + k])
    return out


def repeated_runs(snippets: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur elsewhere in the snippets too: snippet, first and last start of each.

    A window repeats if its suffix has `window` bytes in common with a neighbour's in the
    order of those suffixes that hold a whole window.
    """
    lens = np.asarray([len(s) for s in snippets], np.int64)
    joined = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    valid = np.zeros(len(joined), bool)
    valid[textkit.ranges(first, np.maximum(lens - window + 1, 0))] = True
    sa = two_stage(joined, window, valid)
    hit = np.zeros(len(joined), bool)
    if len(sa) > 1:
        long = common_prefixes(joined, sa, window) >= window
        hit[sa[:-1][long]] = hit[sa[1:][long]] = True
    at = np.flatnonzero(hit)  # starts of different snippets are never next to each other
    edge = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(at) else at
    which = np.searchsorted(first, at[edge], "right") - 1
    last = at[np.append(edge[1:], len(at)) - 1] if len(at) else at
    return which, at[edge] - first[which], last - first[which]


def arrays(d: DataFrame, window: int, light: DataFrame, array_bytes: int = 1 << 17) -> DataFrame:
    """Repeated spans of pieces (rid, gram, a, m, whole) by suffix arrays over each gram's snippets: rid, s, e."""
    per = light.groupBy("rid").agg(F.collect_list(F.struct("gram", "a", "m", "whole")).alias("spots"))
    texts = repeats.dealt(d, repeats.sieve(light)).select("rid", "text").distinct().join(per, "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in repeats.portions(whole)):
            out = []
            for rid, text, spots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                out += [(x["gram"], rid, x["a"], not x["whole"], raw[x["a"] : x["a"] + x["m"] - 1 + window]) for x in spots]
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i : i + 4096]))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())], names=["gram", "rid", "a", "own", "snippet"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            which, low, high = repeated_runs([x[4] for x in held], window)
            rid, at, own = (np.asarray([x[i] for x in held]) for i in (1, 2, 3))
            keep = own[which]
            which = which[keep]
            return pa.record_batch([pa.array(rid[which]), pa.array(low[keep] + at[which]), pa.array(high[keep] + at[which] + window)], names=["rid", "s", "e"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if size >= array_bytes and row[0] != last:
                    yield flush()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flush()

    snippets = texts.select("rid", "text", "spots").mapInArrow(cut, "gram long, rid long, a long, own boolean, snippet binary")
    return snippets.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "rid long, s long, e long")


def resolve(d: DataFrame, window: int, k: int, probes: DataFrame, most_rivals: int = 512, step: int = 24) -> DataFrame:
    """Repeated spans inside unlike pieces: rid, s, e.  probes: rid, gram, a, m, whole, rivals.

    Grams with more than `most_rivals` contents are cut into parts with nearly a whole
    window in common; a part with that many contents still is counted window by window.
    """
    some, many = F.col("rivals") <= most_rivals, F.col("rivals") > most_rivals
    out = arrays(d, window, probes.where(some))
    heavy = probes.where(many)
    if heavy.isEmpty():
        return out
    cuts = shared.cut(repeats.split(d, heavy, "bytes", window, k, step), "parts")
    parts = repeats.rivalry(cuts)
    shared.drop(cuts)
    out = out.unionByName(equal_pieces(d, window, parts)).unionByName(arrays(d, window, parts.where(F.col("probe") & some)))
    crowded = parts.where(F.col("probe") & many).select("rid", "a", "m", "whole")
    if crowded.isEmpty():
        return out
    return out.unionByName(debruijn.verified(d, debruijn.repeated_edges(d, "bytes", window, crowded), "bytes"))


def equal_pieces(d: DataFrame, window: int, flagged: DataFrame) -> DataFrame:
    """Spans of pieces whose contents occur elsewhere: rid, s, e.  Pieces of one hash are held against each other by the bytes at their coordinates."""
    spots = flagged.where("whole").select("rid", F.col("a").alias("s"), (F.col("a") + F.col("m") - 1 + window).alias("e"), F.col("piece").alias("key"), F.lit(True).alias("own"))
    return debruijn.verified(d, shared.cut(spots, "pieces"), "bytes")


def byte_digest(b: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    size, removed, runs, sha = [], [], [], []
    for t, own in zip(b.column("text").to_pylist(), spans):
        raw = t.encode()
        size.append(len(raw))
        if own:
            gone = repeats.cover(len(raw), own)
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        else:
            removed.append(0)
            runs.append(0)
        sha.append(hashlib.sha256(raw).hexdigest())
    return pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove(docs: DataFrame, window: int = 400, k: int = 32, id_col: str = "doc_id", text_col: str = "text", most_rivals: int = 512) -> DataFrame:
    """Bytes covered by a window that starts anywhere else go; one row for each row of docs.

    most_rivals says which grams' snippets are cut further before they are sorted; it does
    not change the result.
    """
    d = repeats.rows(docs, id_col, text_col)
    f = repeats.flagged(d, "bytes", window, k)
    spans = equal_pieces(d, window, f).unionByName(resolve(d, window, k, f.where("probe").select("rid", "gram", "a", "m", "whole", "rivals"), most_rivals))
    return repeats.finish(d, spans, RESULT, byte_digest)
