"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file holds: a fixed header, the document ids, the Elias-Fano code of the
documents' start offsets (low bits packed, high bits unary, and the place of every 512th
set bit among them) and one concatenated array of ids (two bytes each while the
vocabulary allows, else four).  `select(i)` on the code reads the stretch of high bits
between two noted places and gives document i's start without a table of 64-bit offsets.

Texts are encoded by the tokenizer's library.  With a byte-level tokenizer that splits by
its usual expression no pre-token crosses the place before a space that a visible
character follows, and none the one between an ASCII letter and an ASCII mark, so a text's
ids are those of its pieces between such places; each distinct piece is encoded once and
its ids are kept for the next ones.  The tests compare
the ids with those of whole texts over whole tables.  Texts that hold an added token, and
all texts of other tokenizers, are encoded whole.

Defined cases: a null text is an empty one and yields the end id only; repeated rows are
written once each, next to each other; an empty table writes no shard; a null doc_id
comes first; extra columns are ignored; texts of any length stay whole in one shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textkit

MAGIC = b"MTOK2\0\0\0"
HEAD = struct.Struct("<8sIIqqqIIqq")  # magic, width, low bits, docs, ids, ids before, part, block, low bytes, high bytes
NULL_ID = -(1 << 63)


class EliasFano:
    """A non-decreasing sequence of n integers up to u in about 2 + log2(u/n) bits each."""

    STEP = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        lows = (v & np.uint64((1 << bits) - 1)).astype(np.uint64)
        if bits:
            grid = ((lows[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(grid.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ups = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ups[-1]) + 1 if n else 0, np.uint8)
        flags[ups] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ups[:: cls.STEP].astype("<u4"))

    def stretch(self, k: int) -> np.ndarray:
        """Values k*STEP to (k+1)*STEP, from the high bits between two marks."""
        i = np.arange(k * self.STEP, min(self.n, (k + 1) * self.STEP))
        byte = int(self.marks[k]) >> 3
        end = (int(self.marks[k + 1]) >> 3) + 1 if k + 1 < len(self.marks) else len(self.high)
        bit = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + 8 * byte
        bit = bit[np.searchsorted(bit, self.marks[k]) :][: len(i)]
        out = (bit - i) << self.low_bits
        if not self.low_bits:
            return out
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return out | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.stretch(i // self.STEP)[i % self.STEP])


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, before: int, part: int, block: int, width: int) -> bytes:
    ef = EliasFano.encode(starts)
    low, high = ef.low.tobytes(), ef.high.tobytes()
    return HEAD.pack(MAGIC, width, ef.low_bits, len(doc_ids), len(ids), before, part, block, len(low), len(high)) + doc_ids.astype("<i8").tobytes() + ef.marks.tobytes() + low + high + ids.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> dict:
    magic, width, bits, n, m, before, part, block, a, b = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n, at)
    at += 8 * n
    marks = np.frombuffer(data, "<u4", -(-n // EliasFano.STEP), at)
    at += 4 * len(marks)
    low = np.frombuffer(data, np.uint8, a, at)
    high = np.frombuffer(data, np.uint8, b, at + a)
    return {"doc_ids": doc_ids, "starts": EliasFano(n, bits, low, high, marks), "ids": np.frombuffer(data, f"<u{width}", m, at + a + b), "before": before, "part": part, "block": block}


class Encoder:
    """The tokenizer's ids of whole texts, put together from those of their distinct pieces."""

    def __init__(self, path: str, most: int = 500_000):
        import json

        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        j = json.loads(self.tok.to_str())
        pre = j.get("pre_tokenizer") or {}
        self.in_pieces = j.get("normalizer") is None and j["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not j["model"].get("dropout")
        # bytes that begin a visible character for sure: others may begin a space beyond ASCII
        self.visible = np.zeros(256, bool)
        self.visible[0x21:0x7F] = self.visible[0xC3:0xE1] = self.visible[0xE4:] = True
        self.letter = np.zeros(256, bool)
        self.letter[0x41:0x5B] = self.letter[0x61:0x7B] = True
        self.mark = self.visible & ~self.letter
        self.mark[0x30:0x3A] = self.mark[0x80:] = False
        self._clear()

    def _clear(self) -> None:
        """Kept pieces: their numbers, and where the ids of each lie."""
        self.kept: dict[bytes, int] = {}
        self.ids, self.first, self.n = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        got = [e.ids for e in self.tok.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), self.dtype, int(n.sum()))])
        self.kept.update(zip(pieces, range(len(self.kept), len(self.kept) + len(pieces))))

    def starts(self, s: textkit.Slice) -> np.ndarray:
        """Where pieces begin: at rows' starts, at spaces before a visible character, and at marks after a letter (both ASCII)."""
        d, begin = s.data, np.zeros(len(s.data), bool)
        if self.in_pieces and len(d):
            begin[:-1] = (d[:-1] == 0x20) & self.visible[d[1:]]
            begin[1:] |= self.letter[d[:-1]] & self.mark[d[1:]]
            edge = s.off[1:-1] - 1
            edge = edge[edge >= 0]
            begin[edge] &= d[edge] != 0x20  # what follows a row's last byte is another row's
            whole = d.tobytes()
            if any(x in whole for x in self.added):
                for i in range(s.rows):
                    if any(x in s.text(i) for x in self.added):
                        begin[s.off[i] : s.off[i + 1]] = False
        begin[s.off[:-1][np.diff(s.off) > 0]] = True
        return np.flatnonzero(begin)

    def encode(self, s: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's rows one after another, and each row's number of ids."""
        at = self.starts(s)
        if not len(at):
            return np.zeros(0, self.dtype), np.zeros(s.rows, np.int64)
        ends = np.append(at, len(s.data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(s.data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.kept]
        if new and len(self.kept) + len(new) > self.most:
            self._clear()
            new = distinct
        if new:
            self._learn(new)
        which = np.fromiter(map(self.kept.__getitem__, distinct), np.int64, len(distinct))[np.asarray(pieces.indices)]
        n = self.n[which]
        row = np.searchsorted(at, s.off)
        total = np.append(0, np.cumsum(n))
        return self.ids[textkit.ranges(self.first[which], n)], np.diff(total[row])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards in ascending id order; returns a written table (part, block, file, docs, ids, before)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part, block, before, made = TaskContext.get().partitionId(), 0, 0, []
        doc_ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        lens: list[np.ndarray] = []

        def flush() -> None:
            nonlocal block, before
            name, n = f"{to}/ids-{part:06d}-{block:04d}.tok", np.concatenate(lens)
            shared.put(name, pack(np.concatenate(doc_ids), np.cumsum(n) - n, np.concatenate(parts), before, part, block, enc.width))
            made.append((part, block, name.rsplit("/", 1)[1], len(n), int(n.sum()), before))
            before, block = before + int(n.sum()), block + 1
            doc_ids.clear(), parts.clear(), lens.clear()

        for b in batches:
            ids = np.asarray(b.column(0).fill_null(NULL_ID))
            for s in textkit.slices(b.column(1), 1 << 21):
                got, n = enc.encode(s)
                parts.append(np.insert(got, np.cumsum(n), end_id))
                doc_ids.append(ids[s.first : s.first + s.rows])
                lens.append(n + 1)
                if sum(map(len, parts)) >= block_ids:
                    flush()
        if lens:
            flush()
        if made:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*made)), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "block", "file", "docs", "ids", "before"])

    return shared.cut(d.mapInArrow(work, "part int, block int, file string, docs long, ids long, before long"), "token-manifest")


def read(spark: SparkSession, at: str) -> DataFrame:
    """Per document, from the files: doc_id, part, local_start (in its part), n_tokens, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                x = unpack(data.as_py())
                ef, step = x["starts"], EliasFano.STEP
                for k in range(len(ef.marks)):
                    starts = ef.stretch(k)
                    last = ef.select((k + 1) * step) if k + 1 < len(ef.marks) else len(x["ids"])
                    ends = np.append(starts[1:], last)
                    wide = x["ids"][starts[0] : last].astype("<u4")
                    crc = [zlib.crc32(wide[s:e]) for s, e in zip(starts - starts[0], ends - starts[0])]
                    own = x["doc_ids"][k * step : (k + 1) * step]
                    n = len(own)
                    yield pa.record_batch([pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array([x["part"]] * n, pa.int32()), pa.array(starts + x["before"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.tok").load(at)
    return files.select("content").mapInArrow(work, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str, end_id: int = 0, to: str | None = None, **names) -> DataFrame:
    """Writes the shards, reads them back, and places each document in the whole id array."""
    spark = docs.sparkSession
    to = to or shared.folder(spark, "tokens")
    made = write(docs, to, tokenizer, end_id, **names)
    # one row for each part: their number is the writers', not the documents'
    totals = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    if not offsets:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
    base = F.broadcast(spark.createDataFrame(offsets, "part int, _base long"))
    return read(spark, to).join(base, "part").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part")
