"""Alignment of two tokenizers' tokens over a corpus, counted by external spilling.

A byte-level tokenizer (A) and a piece tokenizer (B) cut the same bytes, a space and the
text.  Where tokens of both end together a group ends, and its last two tokens are
linked.  How often an id pair is linked in the whole corpus tells which ids of A stand for
an id of B.

Tasks that encode texts keep records (pair, document, times) until `spill_records` of them
or `spill_docs` documents are gathered, sort them by pair (the id of B first), and spill
them as runs, one for each radix of B's id: a Zstandard frame of pairs with their totals,
and one of the documents behind them.  The runs of a radix, dealt to several tasks where
they are many, are merged with a heap of their heads, which counts each pair; the partial
counts are merged in the same way, and since all pairs of an id of B come one after the
other, its highest count is known where its last pair passes.  Counts and highest counts
of a radix are then held against its runs, which stream back each document's part; parts
are summed up by spill.  A pair that very many documents hold is in as many runs as there
are spills, and these are dealt to tasks by size, so no task gets all records of an id.

Both tokenizers cut at places that depend on neighbouring bytes alone, so ids of texts
are put together from those of distinct pieces between such places (tests hold them
against whole texts).  B's pieces hold U+2581 for a space in front only; its texts are
cut before each space that follows another character.

Defined cases: a null text, an empty one, and one whose tokens of A or B do not spell
space + text (a text with U+2581, say) have no tokens: zeros and an empty string; repeated
rows count as often as they occur; strings of special tokens are plain text; a null id is
a row like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textkit, tokens

RADIX_BITS = 5
DOC = ("n_a", "n_b", "n_groups", "n_links")
PAIR = 32  # a pair is B's id and A's id, 32 bits each


class ByteTokens(tokens.Encoder):
    """A: the tokenizers library, special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.added = []
        # byte-level vocabularies write visible Latin-1 characters as themselves and the other bytes as what follows U+0100
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.table = Spelling([bytes(self.byte.get(c, 0) for c in self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())])


class PieceTokens(tokens.Encoder):
    """B: the sentencepiece library; pieces end before a space that follows another character."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.sp, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.in_pieces = not any("▁" in x.lstrip("▁") for x in names)
        self.table = Spelling([bytes([int(x[1:-1], 16)]) if self.sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self._clear()

    def starts(self, s: textkit.Slice) -> np.ndarray:
        begin = np.zeros(len(s.data), bool)
        if self.in_pieces and len(s.data):
            space = s.data == 0x20
            begin[1:] = space[1:] & ~space[:-1]
        begin[s.off[:-1][np.diff(s.off) > 0]] = True
        return np.flatnonzero(begin)

    def _learn(self, pieces: list[bytes]) -> None:
        # the library puts the first space back, but makes nothing of a text that is empty without it (a single space at a text's end)
        got = self.sp.encode([x[1:].decode("utf-8", "replace") for x in pieces], num_threads=1)
        got = [y if x != b" " else [self.sp.piece_to_id("▁")] for x, y in zip(pieces, got)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), self.dtype, int(n.sum()))])
        self.kept.update(zip(pieces, range(len(self.kept), len(self.kept) + len(pieces))))


class Spelling:
    """The bytes of every id, and the digits of its number."""

    def __init__(self, names: list[bytes]):
        self.size = np.asarray([len(x) for x in names], np.int64)
        self.first = np.append(0, np.cumsum(self.size))
        self.data = np.frombuffer(b"".join(names), np.uint8)
        width = len(str(max(len(names) - 1, 1))) + 1
        digits = [str(i).encode() for i in range(len(names))]
        self.n_digits = np.asarray([len(x) for x in digits], np.int64)
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in digits), np.uint8).reshape(-1, width)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.data[textkit.ranges(self.first[ids], self.size[ids])]


_held: dict[tuple, object] = {}


def _tokenizer(kind: type, path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (kind, path) not in _held:
        _held[kind, path] = kind(path)
    return _held[kind, path]


def _faithful(s: textkit.Slice, ids: np.ndarray, n: np.ndarray, table: Spelling) -> np.ndarray:
    """Which rows' tokens spell the row."""
    size = table.size[ids]
    row = np.repeat(np.arange(s.rows), n)
    fits = np.bincount(row, size, s.rows).astype(np.int64) == np.diff(s.off)
    own = fits[row]
    want = s.data[np.repeat(fits, np.diff(s.off))]
    wrong = np.flatnonzero(table.spelled(ids[own]) != want)
    if len(wrong):
        rows = np.flatnonzero(fits)
        off = np.append(0, np.cumsum(np.diff(s.off)[rows]))
        fits[rows[np.searchsorted(off, wrong, "right") - 1]] = False
    return fits


def _written(table_a: Spelling, a: np.ndarray, last_a: np.ndarray, table_b: Spelling, b: np.ndarray, last_b: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2,b3` for tokens in groups; last_*: a group's last token, final: a text's last group.  And the end of each group."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    at_a = np.arange(len(a)) + np.append(0, ends_b)[group_a]
    at_b = np.arange(len(b)) + ends_a[group_b]
    wide = max(table_a.digits.shape[1], table_b.digits.shape[1])
    cell = np.zeros((len(a) + len(b), wide), np.uint8)
    size = np.zeros(len(cell), np.int64)
    for at, ids, t, last, mark in ((at_a, a, table_a, last_a, ord("|")), (at_b, b, table_b, last_b, ord(";"))):
        cell[at, : t.digits.shape[1]] = t.digits[ids]
        size[at] = t.n_digits[ids]
        cell[at, t.n_digits[ids]] = np.where(last, mark, ord(","))
    used = size + 1
    used[at_b[last_b][final]] -= 1
    out = cell[np.arange(wide) < used[:, None]]
    return out, np.cumsum(used)[at_b[last_b]]


def _frame(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in a Zstandard frame."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(arrays[0])).tobytes(), *[np.ascontiguousarray(x).tobytes() for x in arrays]]))


def _arrays(frame: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(frame), 8, []
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def _counts_frame(pair: np.ndarray, n: np.ndarray, *more: np.ndarray) -> bytes:
    return _frame(np.diff(pair, prepend=0), n, *more)


def _counts(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = _arrays(frame, "<i8", "<i8")
    return np.cumsum(step), n


class Spill:
    """Records of texts, spilled as one run for each radix."""

    def __init__(self, part: int):
        self.part, self.spilled, self.docs, self.records = part, 0, 0, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def chunk(self) -> int:
        return (self.part << 32) | self.spilled

    def add(self, pair: np.ndarray, row: np.ndarray, rows: int) -> None:
        order = np.lexsort((row, pair))
        pair, row = pair[order], row[order]
        edge = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(row) != 0))) if len(pair) else np.zeros(0, np.int64)
        self.held.append((pair[edge], row[edge] + self.docs, np.diff(np.append(edge, len(pair)))))
        self.docs += rows
        self.records += len(edge)

    def runs(self) -> list[tuple[int, int, int, bytes, bytes]]:
        """(chunk, documents, radix, pairs with totals, their documents); and a new chunk begins."""
        out = []
        if self.records:
            pair, doc, n = map(np.concatenate, zip(*self.held))
            radix = (pair >> PAIR) & ((1 << RADIX_BITS) - 1)
            order = np.lexsort((doc, pair, radix))
            pair, doc, n, radix = pair[order], doc[order], n[order], radix[order]
            edge = np.flatnonzero(np.append(True, np.diff(pair) != 0))
            total, docs = np.add.reduceat(n, edge), np.diff(np.append(edge, len(pair)))
            heads = np.searchsorted(radix[edge], np.arange((1 << RADIX_BITS) + 1))
            for r in range(1 << RADIX_BITS):
                i, j = heads[r], heads[r + 1]
                if i < j:
                    body = slice(edge[i], edge[j] if j < len(edge) else len(pair))
                    out.append((self.chunk, self.docs, r, _counts_frame(pair[edge[i:j]], total[i:j]), _body(docs[i:j], doc[body], n[body])))
        self.held, self.docs, self.records = [], 0, 0
        self.spilled += 1
        return out


def _body(docs: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """Documents for each pair, and documents and times for each record."""
    import zstandard

    parts = [np.asarray([len(docs), len(doc)], "<i8"), docs.astype("<i4"), doc.astype("<i4"), n.astype("<i4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if x.itemsize == 4 else x.tobytes() for x in parts))


def _records(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(frame)
    p, r = np.frombuffer(raw, "<i8", 2).tolist()
    out, at = [], 16
    for n in (p, r, r):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel())
        at += 4 * n
    return tuple(out)


def encode(docs: DataFrame, tokenizer_a: str, model_b: str, spill_records: int = 1 << 19, spill_docs: int = 1 << 12) -> DataFrame:
    """A written table with a row for each text (chunk, ord, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and one for each run (chunk, docs, radix, head, body)."""
    names = ["chunk", "ord", "doc_id", *DOC, "groups_sha256", "docs", "radix", "head", "body"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = _tokenizer(ByteTokens, tokenizer_a), _tokenizer(PieceTokens, model_b)
        spill = Spill(TaskContext.get().partitionId())
        id_type = None

        def runs() -> pa.RecordBatch | None:
            got = spill.runs()
            if not got:
                return None
            chunk, n, radix, head, body = zip(*got)
            none = lambda kind: pa.nulls(len(got), kind)
            return pa.RecordBatch.from_arrays([pa.array(chunk), none(pa.int32()), none(id_type), *[none(pa.int64())] * 4, none(pa.string()), pa.array(n, pa.int32()), pa.array(radix, pa.int32()), pa.array(head, pa.binary()), pa.array(body, pa.binary())], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for s in textkit.slices(batch.column(1)):
                ids_a, n_a = a.encode(s)
                ids_b, n_b = b.encode(s)
                ok = (np.diff(s.off) > 1) & _faithful(s, ids_a, n_a, a.table) & _faithful(s, ids_b, n_b, b.table)
                ids_a, ids_b = (x[np.repeat(ok, n)].astype(np.int64) for x, n in ((ids_a, n_a), (ids_b, n_b)))
                n_a, n_b = n_a * ok, n_b * ok
                end_a, end_b = np.cumsum(a.table.size[ids_a]), np.cumsum(b.table.size[ids_b])
                mark = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
                mark[0, end_a] = mark[1, end_b] = True
                last_a, last_b = mark[1, end_a], mark[0, end_b]
                row = np.repeat(np.arange(s.rows), n_a)[last_a]
                links = np.bincount(row, minlength=s.rows)
                sha = [""] * s.rows
                if len(row):
                    text, stop = _written(a.table, ids_a, last_a, b.table, ids_b, last_b, np.append(row[1:] != row[:-1], True))
                    rows = np.flatnonzero(links)
                    stops = stop[np.append(row[1:] != row[:-1], True)]
                    for r, i, j in zip(rows.tolist(), np.append(0, stops[:-1]).tolist(), stops.tolist()):
                        sha[r] = hashlib.sha256(text[i:j]).hexdigest()
                spilled, first = spill.chunk, spill.docs
                spill.add((ids_b[last_b] << PAIR) | ids_a[last_a], row, s.rows)
                none = lambda kind, n=s.rows: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.rows, spilled)), pa.array(np.arange(first, first + s.rows, dtype=np.int32)), batch.column(0).slice(s.first, s.rows), *[pa.array(x.astype(np.int64)) for x in (n_a, n_b, links, links)],
                     pa.array(sha, pa.string()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary())], names=names)
                if spill.records >= spill_records or spill.docs >= spill_docs:
                    if (out := runs()) is not None:
                        yield out
        if (out := runs()) is not None:
            yield out

    d = docs.select("doc_id", F.concat(F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    kinds = f"chunk long, ord int, doc_id {dict(d.dtypes)['doc_id']}, " + "".join(f"{c} long, " for c in DOC) + "groups_sha256 string, docs int, radix int, head binary, body binary"
    return shared.cut(d.mapInArrow(work, kinds), "spills")


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in order of pairs, from runs (pairs, counts) each in that order, by a heap of the runs' heads."""
    lists = [(p.tolist(), n.tolist()) for p, n in runs if len(p)]
    heap = [(p[0], k, 0) for k, (p, _) in enumerate(lists)]
    heapq.heapify(heap)
    now, total = -1, 0
    while heap:
        pair, k, i = heap[0]
        p, n = lists[k]
        if pair != now:
            if total:
                yield now, total
            now, total = pair, 0
        total += n[i]
        i += 1
        if i < len(p):
            heapq.heapreplace(heap, (p[i], k, i))
        else:
            heapq.heappop(heap)
    if total:
        yield now, total


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Neighbouring rows with equal first columns: (key, rows of the other columns)."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield key, rows


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    got = np.fromiter((x for pn in merge(runs) for x in pn), np.int64)
    return got[::2], got[1::2]


def counts(runs: DataFrame) -> DataFrame:
    """radix, split, table: every pair of the radix with its count and the highest count of its id of B, packed; for each split of the radix.

    runs: radix, split, splits, head.
    """

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, _), rows in _grouped(batches, 2):
            yield pa.record_batch([pa.array([radix], pa.int32()), pa.array([rows[0][0]], pa.int32()), pa.array([_counts_frame(*_merged([_counts(h) for _, h in rows]))], pa.binary())], names=["radix", "splits", "head"])

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), rows in _grouped(batches, 1):
            pair, n = _merged([_counts(h) for _, h in rows])
            # all pairs of an id of B are neighbours
            edge = np.flatnonzero(np.append(True, np.diff(pair >> PAIR) != 0))
            most = np.repeat(np.maximum.reduceat(n, edge), np.diff(np.append(edge, len(n))))
            yield pa.record_batch([pa.array([radix], pa.int32()), pa.array([rows[0][0]], pa.int32()), pa.array([_counts_frame(pair, n, most)], pa.binary())], names=["radix", "splits", "table"])

    part = runs.select("radix", "split", "splits", "head").repartition("radix", "split").sortWithinPartitions("radix", "split").mapInArrow(partly, "radix int, splits int, head binary")
    return part.repartition("radix").sortWithinPartitions("radix").mapInArrow(wholly, "radix int, splits int, table binary")


def dealt(runs: DataFrame, split_bytes: int) -> DataFrame:
    """runs with split and splits: as many splits of a radix as its bytes ask for."""
    per = runs.groupBy("radix").agg(F.ceil(F.sum(F.length("head") + F.length("body")) / split_bytes).cast("int").alias("splits"))
    # one row for each radix
    return runs.join(F.broadcast(per), "radix").withColumn("split", F.pmod(F.xxhash64("chunk"), F.col("splits")).cast("int"))


def shares(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """chunk, ord, n_best, count_sum: what every document gets back from the counts of its links."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = n = most = None
        for b in batches:
            for chunk, docs, head, body, table in zip(*(b.column(c).to_pylist() for c in ("chunk", "docs", "head", "body", "table"))):
                if table is not None:  # sorts before the runs of its split
                    step, n, most = _arrays(table, "<i8", "<i8", "<i8")
                    pair = np.cumsum(step)
                    continue
                at = np.searchsorted(pair, _counts(head)[0])
                per, doc, times = _records(body)
                count, best = np.repeat(n[at], per), np.repeat(n[at] == most[at], per)
                whole = np.zeros((2, docs), np.int64)
                np.add.at(whole[0], doc[best], times[best])
                np.add.at(whole[1], doc, times * count)
                yield pa.record_batch([pa.array([chunk]), pa.array([whole.tobytes()], pa.binary())], names=["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in _grouped(batches, 1):
            whole = sum(np.frombuffer(x, "<i8") for (x,) in rows).reshape(2, -1)
            k = whole.shape[1]
            yield pa.record_batch([pa.array(np.full(k, chunk)), pa.array(np.arange(k, dtype=np.int32)), pa.array(whole[0]), pa.array(whole[1])], names=["chunk", "ord", "n_best", "count_sum"])

    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    first = tables.select("radix", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(-1).cast("long").alias("chunk"), none("docs", "int"), none("head", "binary"), none("body", "binary"), "table")
    both = first.unionByName(runs.select("radix", "split", "chunk", "docs", "head", "body", none("table", "binary")))
    parts = both.repartition("radix", "split").sortWithinPartitions("radix", "split", "chunk").mapInArrow(stream, "chunk long, part binary")
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk long, ord int, n_best long, count_sum long")


def align(docs: DataFrame, tokenizer_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", split_bytes: int = 1 << 25, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and per linked pair of ids: b, a, n, best.

    n_best: links whose pair has the highest count of all pairs of its id of B, count_sum:
    the sum of the counts of the row's links.  best: whether n is the highest of b's.
    """
    spills = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer_a, model_b, **sizes)
    runs = dealt(spills.where("radix is not null").select("chunk", "docs", "radix", "head", "body"), split_bytes)
    tables = shared.cut(counts(runs), "pair-counts")
    texts = spills.where("radix is null").select("chunk", "ord", "doc_id", *DOC, "groups_sha256")
    back = shares(runs, tables)
    out = texts.join(back, ["chunk", "ord"], "left").select("doc_id", *DOC, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return out, pairs(tables)


def pairs(tables: DataFrame) -> DataFrame:
    """b, a, n, best of every linked pair of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table in b.column(0).to_pylist():
                step, n, most = _arrays(table, "<i8", "<i8", "<i8")
                pair = np.cumsum(step)
                yield pa.record_batch([pa.array((pair >> PAIR).astype(np.int32)), pa.array((pair & ((1 << PAIR) - 1)).astype(np.int32)), pa.array(n), pa.array(n == most)], names=["b", "a", "n", "best"])

    return tables.select("table").mapInArrow(work, "b int, a int, n long, best boolean")
