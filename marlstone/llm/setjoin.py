"""N-gram Jaccard join with set-relation skipping.

Sets are word shingles; equal sets collapse to one.  Every set is indexed under the
first shingles of a global order (rare first), as many as any set similar enough must
share one of.  Index lists are skipped by block and position: an entry stays only if its
neighbourhood of set sizes in the list holds another one whose position and size leave
room for the overlap that a link needs.

Every list names its most central entry, the one with the fewest rare shingles before
it.  Sets that meet under one centre form a cluster, and a centre that lies in a larger
cluster hands its own over to that one.  Two similar sets thus meet in some cluster.

A cluster's answers are derived from one set's: the overlaps with it bound all others
from both sides, and what the bounds leave open follows from the few shingles in which
sets differ from it.  Clusters are dealt to tasks in pairs of blocks of bounded size, and
each task gives one row for each set (its number of links and the set that stands for
its part), never one for each pair.

Defined cases: a null text or one without words has an empty set and no link; fewer
words than a shingle make one shingle; repeated rows link with each other; a null id is
a row like any other, whose class and component are named by the other ids in it; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared, textkit

BLOCK = 1 << 12


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """first row, offsets, hashes: the sorted distinct shingles of every row of a slice."""
    for s in textkit.slices(texts):
        s.words(fold=True)
        n = len(s.h)
        spans = textkit.Spans(s.h)
        count = np.diff(s.word_off)
        per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        row = np.repeat(np.arange(s.rows), per)
        at = textkit.ranges(s.word_off[:-1], per)
        end = np.minimum(at + k, s.word_off[1:][row]) if n else at
        h = spans.hash(at, end)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
        yield s.first, np.searchsorted(row, np.arange(s.rows + 1)), h


def names(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set, from order-free sums of its hashes."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(h ^ np.uint64(0x51ED2705)))])
    n = np.diff(off)
    return textkit.mix((total[off[1:]] - total[off[:-1]]) + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def slots_for(rows: int) -> int:
    """Slots of the shingle counts: they grow with the table, from 2**19 to 2**23."""
    return 1 << min(max(rows.bit_length(), 19), 23)


def packed(block: np.ndarray) -> bytes:
    """Counts of a block of slots: places and counts of those that are not 0 where these are few, else all counts, in as few bytes as the largest needs."""
    own = np.flatnonzero(block)
    width = 1 if block.max() < 1 << 8 else 2 if block.max() < 1 << 16 else 4
    if len(own) * (2 + width) < BLOCK * width:
        return bytes([width | 8]) + own.astype("<u2").tobytes() + block[own].astype(f"<u{width}").tobytes()
    return bytes([width]) + block.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places in a block, and their counts."""
    width = data[0] & 7
    if not data[0] & 8:
        return slice(None), np.frombuffer(data, f"<u{width}", offset=1)
    n = (len(data) - 1) // (2 + width)
    return np.frombuffer(data, "<u2", n, 1), np.frombuffer(data, f"<u{width}", n, 1 + 2 * n)


def survey(d: DataFrame, k: int, slots: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, n_shingles, sid), and each task's shingle counts by slot (block, salt, counts), for blocks that it has any in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(slots, np.int64)
        empty = lambda n, kind: pa.nulls(n, kind)
        for b in batches:
            size, sid = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for first, off, h in shingle_sets(b.column(1), k):
                n = len(off) - 1
                size[first : first + n], sid[first : first + n] = np.diff(off), names(off, h)
                total += np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(sid), empty(n, pa.int32()), empty(n, pa.int32()), empty(n, pa.binary())], names=columns)
        if total.any():
            part, blocks = TaskContext.get().partitionId(), np.minimum(total, 2**32 - 1).reshape(-1, BLOCK)
            own = np.flatnonzero(blocks.any(axis=1))
            n = len(own)
            yield pa.record_batch([empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), pa.array(own.astype(np.int32)), pa.array(np.full(n, part % 64, np.int32)), pa.array([packed(blocks[k]) for k in own], pa.binary())], names=columns)

    columns = ["doc_id", "n_shingles", "sid", "block", "salt", "counts"]
    return d.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, sid long, block int, salt int, counts binary")


def frequencies(parts: DataFrame, slots: int) -> np.ndarray:
    """Shingle counts over all rows by slot, summed up in two steps: a table of fixed size, whatever the input."""

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(BLOCK, np.int64)
        for x in pdf["counts"]:
            at, n = unpacked(x)
            total[at] += n
        return pd.DataFrame({"block": [key[0]], "salt": [0], "counts": [packed(np.minimum(total, 2**32 - 1))]})

    kind = "block int, salt int, counts binary"
    out = np.zeros(slots, np.uint32)
    for r in parts.groupBy("block", "salt").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind).collect():
        at, n = unpacked(bytes(r["counts"]))
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK][at] = n
    return np.minimum(out, (1 << 24) - 1)


def index(d: DataFrame, freq: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Prefix entries: token, sid, size, pos.  Rows with equal sets give equal entries."""
    held = d.sparkSession.sparkContext.broadcast(freq)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        mask = np.uint64(len(table) - 1)
        for b in batches:
            for _, off, h in shingle_sets(b.column(0), k):
                size, sid = np.diff(off), names(off, h)
                fresh = np.zeros(len(sid), bool)
                fresh[np.unique(sid, return_index=True)[1]] = True
                row = np.repeat(np.arange(len(size)), size)
                rank = (table[(h & mask).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
                order = np.lexsort((h, rank, row))
                need = -(-size * num // den)  # the least overlap with any set that matches
                prefix = np.where(fresh & (size > 0), size - need + 1, 0)
                at = textkit.ranges(off[:-1], prefix)
                own = row[at]
                if len(at):
                    yield pa.record_batch([pa.array(h[order[at]].view(np.int64)), pa.array(sid[own]), pa.array(size[own].astype(np.int32)), pa.array((at - off[own]).astype(np.int32))], names=["token", "sid", "size", "pos"])

    return d.select("text").mapInArrow(work, "token long, sid long, size int, pos int")


def open_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries (token, sid, size, pos) that may have a partner in their list, as far as sizes and positions tell.

    The remainders behind a pair's first shared token bound its overlap, so that with
    room = (den+num)(size-pos) - num*size each one's room must reach num times the other's
    size.  Whole lists are looked at first, which settles those of two entries; what is
    left looks at its own and the two neighbouring cells of set sizes.
    """
    c = F.col
    twice = shared.cut(entries.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token"), "tokens")
    lists = shared.cut(shared.matching(entries, twice, "token").distinct(), "lists")
    shared.drop(twice)
    cell = F.floor(F.log("size") / math.log(den / num) + 1e-9).cast("int").alias("cell")
    room = ((den + num) * (c("size") - c("pos")).cast("long") - num * c("size")).alias("room")
    sums = (F.count("*").alias("_n"), F.sum("size").alias("_s"), F.sum("room").alias("_r"), F.max("room").alias("_most"), F.min("size").alias("_least"))
    other, others = c("_s") - c("size"), c("_r") - c("room")  # of the one other entry, where there is just one
    one = (den * F.least("size", other) >= num * F.greatest("size", other)) & (c("room") >= num * other) & (others >= num * c("size"))
    more = (c("_most") >= num * c("size")) & (c("room") >= num * c("_least"))
    may = F.when(c("_n") == 2, one).otherwise((c("_n") > 2) & more)
    own = lists.select("token", "sid", "size", "pos", room)
    out = shared.cut(own.join(own.groupBy("token").agg(*sums).where("_n > 1"), "token").where(may).select("token", "sid", "size", "pos"), "open")
    shared.drop(lists)
    own = out.select("token", "sid", "size", "pos", room, cell)
    near = own.select("token", F.explode(F.array(c("cell") - 1, c("cell"), c("cell") + 1)).alias("cell"), "size", "room")
    last, out = out, shared.cut(own.join(near.groupBy("token", "cell").agg(*sums).where("_n > 1"), ["token", "cell"]).where(may).select("token", "sid", "size", "pos"), "open")
    shared.drop(last)
    return out


def clusters(open_: DataFrame) -> DataFrame:
    """sid, centre, away (how far from central), size: the clusters in which each set meets others."""
    c = F.col
    away = (c("pos") / c("size")).alias("away")
    lead = open_.groupBy("token").agg(F.min(F.struct(away, "sid")).alias("_m"), F.count("*").alias("_n")).where("_n > 1").select("token", c("_m.sid").alias("centre"))
    at = open_.join(lead, "token").groupBy("sid", "centre").agg(F.min(away).alias("away"), F.first("size").alias("size"))
    at = shared.cut(at, "centres")
    count = at.groupBy("centre").agg(F.count("*").alias("_c"))
    up = at.where("sid <> centre").join(count, "centre").join(count.select(c("centre").alias("sid"), c("_c").alias("_own")), "sid")
    up = up.where((c("_c") > c("_own")) | ((c("_c") == c("_own")) & (c("centre") < c("sid")))).groupBy("sid").agg(F.max(F.struct("_c", -c("centre"), "centre")).alias("_up"))
    up = up.select(c("sid").alias("centre"), c("_up.centre").alias("_to"))
    out = at.join(up, "centre", "left").groupBy("sid", F.coalesce("_to", "centre").alias("centre")).agg(F.min("away").alias("away"), F.first("size").alias("size"))
    out = shared.cut(out, "clusters")
    shared.drop(at)
    return out


def load(d: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """sid, items (sorted 64-bit shingle hashes) of the sets named in ids."""
    bitmap = shared.sieve(ids, "sid")
    held = d.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, off, h in shingle_sets(b.column(0), k):
                sid = names(off, h)
                rows = np.unique(sid, return_index=True)[1]
                rows = rows[(np.diff(off)[rows] > 0) & (True if held.value is None else shared.within(held.value, sid[rows]))]
                for i in range(0, len(rows), 256):
                    own = rows[i : i + 256]
                    yield pa.record_batch([pa.array(sid[own]), pa.array([h[off[j] : off[j + 1]].tobytes() for j in own], pa.binary())], names=["sid", "items"])

    return d.select("text").mapInArrow(work, "sid long, items binary").groupBy("sid").agg(F.first("items").alias("items"))


def in_common(owner: np.ndarray, elem: np.ndarray, g: int, few: int = 32) -> np.ndarray:
    """How many elements each two of g owners share; rows (owner, elem) are distinct."""
    order = np.argsort(elem, kind="stable")
    o, e = owner[order], elem[order]
    edge = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, np.int64)
    held = np.diff(np.append(edge, len(e)))
    out = np.zeros(g * g, np.int64)
    for n in np.unique(held[(held > 1) & (held <= few)]).tolist():
        first, step = edge[held == n], max(1, (1 << 20) // (n * n))
        for i in range(0, len(first), step):
            m = o[first[i : i + step, None] + np.arange(n)]
            out += np.bincount((m[:, :, None] * g + m[:, None, :]).ravel(), minlength=g * g)
    out = out.reshape(g, g)
    first, n = edge[held > few], held[held > few]
    step = max(1, (1 << 22) // g)
    for i in range(0, len(first), step):  # elements that many owners hold: a matrix product
        own = n[i : i + step]
        x = np.zeros((g, len(own)), np.float32)
        x[o[textkit.ranges(first[i : i + step], own)], np.repeat(np.arange(len(own)), own)] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], base: int, num: int, den: int, room: int = 1 << 21) -> np.ndarray:
    """Which two of the sets are similar, derived from the overlaps with sets[base]."""
    g = len(sets)
    size = np.asarray([len(x) for x in sets], np.int64)
    owner, elem = np.repeat(np.arange(g), size), np.concatenate(sets)
    z = sets[base] if g * len(sets[base]) <= room else sets[base][:0]
    at = np.minimum(np.searchsorted(z, elem), max(len(z) - 1, 0))
    inside = z[at] == elem if len(z) else np.zeros(len(elem), bool)
    common = np.bincount(owner[inside], minlength=g)
    least = common[:, None] + common[None, :] - len(z)
    most = np.minimum(common[:, None], common[None, :]) + np.minimum((size - common)[:, None], (size - common)[None, :])
    need = num * (size[:, None] + size[None, :])
    sure = (den + num) * least >= need
    if (sure == ((den + num) * most >= need)).all():
        return sure
    lacks = np.ones((g, len(z)), bool)
    lacks[owner[inside], at[inside]] = False
    who, what = np.nonzero(lacks)
    both = in_common(np.concatenate([owner[~inside], who]), np.concatenate([elem[~inside], z[what]]), g)
    return (den + num) * (least + both) >= need


def meet(rows: DataFrame, num: int, den: int) -> DataFrame:
    """sid, n (rows linked with it), root (a set it is joined with) of every set with a link in its task.

    rows: centre, i, j, block, sid, away, weight, before, items.  A pair counts in the first
    of the clusters in which it meets: `before` has a set's clusters ahead of this one.
    """
    columns = ["centre", "i", "j", "block", "sid", "away", "weight", "before", "items"]

    def answer(held: list[tuple]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        block, sid, weight = (np.asarray([r[c] for r in held], np.int64) for c in (3, 4, 6))
        joined = linked([np.frombuffer(r[8], np.uint64) for r in held], min(range(len(held)), key=lambda x: (held[x][5], held[x][4])), num, den)
        np.fill_diagonal(joined, False)
        if not joined.any():
            return None
        own = np.arange(len(held))
        root = own
        while True:
            now = np.minimum(root, np.where(joined, root[None, :], len(held)).min(axis=1))
            if (now == root).all():
                break
            root = now
        count = joined if held[0][1] == held[0][2] else joined & (block[:, None] != block[None, :])
        ahead = [r[7] for r in held]
        if sum(map(bool, ahead)) > 1:
            count = count & (in_common(np.repeat(own, [len(x) for x in ahead]), np.asarray([y for x in ahead for y in x], np.int64), len(held)) == 0)
        out = np.flatnonzero(joined.any(axis=1))
        return pa.record_batch([pa.array(sid[out]), pa.array((count @ weight)[out]), pa.array(sid[root[out]])], names=["sid", "n", "root"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                if held and held[0][:3] != row[:3]:
                    if (out := answer(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if (out := answer(held)) is not None:
            yield out

    return rows.select(columns).repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "sid").mapInArrow(work, "sid long, n long, root long")


def links(d: DataFrame, every: DataFrame, freq: np.ndarray, k: int, num: int, den: int, block_sets: int = 512, block_items: int = 1 << 20) -> DataFrame:
    """sid, n, root rows of all links between different sets (see meet).  every: sid of each row."""
    c = F.col
    entries = shared.cut(index(d, freq, k, num, den), "entries")
    open_ = open_lists(entries, num, den)
    shared.drop(entries)
    at = clusters(open_)
    shared.drop(open_)
    per = at.groupBy("centre").agg(F.count("*").alias("_g"), F.sum("size").alias("_z")).where("_g > 1")
    per = per.select(c("centre").alias("_c"), F.greatest(F.ceil(c("_g") / block_sets), F.ceil(c("_z") / block_items)).cast("int").alias("blocks"))
    at = at.join(per, c("centre") == c("_c")).drop("_c", "size")
    many = at.groupBy("sid").agg(F.sort_array(F.collect_set("centre")).alias("_all")).where(F.size("_all") > 1)
    at = at.join(many, "sid", "left").withColumn("before", F.coalesce(F.filter("_all", lambda x: x < c("centre")), F.array().cast("array<bigint>"))).drop("_all")
    weight = every.join(at.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("weight"))
    at = shared.cut(at.join(weight, "sid"), "met")
    rows = at.join(load(d, at.select("sid").distinct(), k), "sid").withColumn("block", F.pmod(F.xxhash64("sid"), c("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), c("blocks") - 1))).withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    out = shared.cut(meet(rows, num, den), "links")
    shared.drop(at)
    return out


def _results(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    g = math.gcd(num, den)
    num, den = num // g, den // g
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slots = slots_for(d.count())
    seen = shared.cut(survey(d, k, slots), "survey")
    every = seen.where("block is null").select("doc_id", "n_shingles", "sid")
    freq = frequencies(seen.where("block is not null").select("block", "salt", "counts"), slots)
    found = links(d, every.select("sid"), freq, k, num, den)
    comp = graph.components(found.where("sid <> root").select(F.col("sid").alias("u"), F.col("root").alias("v")))
    sets = every.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    more = found.groupBy("sid").agg(F.sum("n").alias("_more"))
    more = more.join(comp.withColumnRenamed("node", "sid"), "sid", "full").select(F.col("sid").alias("_s"), "_more", "root")
    sets = sets.join(more, sets["sid"] == more["_s"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"), (F.coalesce("_more", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    sets = shared.cut(sets, "sets")
    shared.drop(found, comp)
    roots = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    per = sets.join(roots, "root").select(F.col("sid").alias("_sid"), "component_id", F.col("least").alias("class_id"), "n_links")
    out = every.join(per, (every["sid"] == per["_sid"]) & (every["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", *[F.coalesce(x, y).alias(x) for x, y in (("component_id", F.col("doc_id")), ("class_id", F.col("doc_id")), ("n_links", F.lit(0).cast("long")))])


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links for each row; links: Jaccard >= num/den.

    component_id is the least id of the rows linked, directly or not, class_id the least
    one of the rows with the same set, n_links the number of other rows linked with this
    one, those of its class among them.
    """
    return _results(docs, k, num, den, id_col, text_col)


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return _results(docs, k, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")
