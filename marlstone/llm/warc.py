"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, then a
skippable frame with the seek table (the public seekable format: compressed and plain
size of every frame, their number, and a magic number at the very end).  A record is
found by bundle, frame and offset inside the frame, so one frame is all that is read.

Records are those of WARC 1.1: a warcinfo record opens every bundle, a response holds an
HTTP head and the payload, a revisit the head alone.  Pages have no time of capture;
`date` stands for it.  Records with equal payloads of at least `least` bytes are stored
once: the one with the largest id is the response, the others are revisits.

Defined cases: a null payload is empty; a null url is written as the record's id and read
as null; repeated ids keep a record each (equal rows with the largest id are all
responses) and so does a null id; an empty table writes an empty folder, which reads as no rows; extra columns
are ignored; frames grow beyond their usual size for one long record only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Payload digest, size and record type of each page: page_id, url, payload, digest, refers_to."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    # only groups of two or more matter; their largest id is found before anything wide moves
    firsts = p.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("_d"), F.col("bytes").alias("_n")).agg(F.max("page_id").alias("_top"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    out = p.join(firsts, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_n")), "left")
    return out.select("page_id", "url", "payload", "digest", "bytes", F.when(F.col("_top") != F.col("page_id"), F.col("_top")).alias("refers_to"))


def name(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _lines(kind: str, record_id: str, date: str, more: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(bundle: str, date: str) -> bytes:
    """The warcinfo record that opens a bundle."""
    return _lines("warcinfo", f"urn:bundle:{bundle}", date, [f"WARC-Filename: {bundle}", "Content-Type: application/warc-fields"], b"software: marlstone\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = ["WARC-Target-URI: " + (name(page_id) if url is None else url.replace("\r", "%0D").replace("\n", "%0A")), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        return _lines("response", name(page_id), date, more, http + payload)
    more += [f"WARC-Refers-To: <{name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _lines("revisit", name(page_id), date, more, http)


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """The record at `at`: headers, block, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 4 + size + 4


def http(block: bytes) -> tuple[int, bytes]:
    """The length that an HTTP head states, and what follows it."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:]), payload


def bundle(records: Iterator[bytes], frame_bytes: int, level: int) -> tuple[bytes, list[tuple[int, int, int, int, int]]]:
    """The file, and for each record: frame, the frame's place and size, offset in the plain frame, length."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    out, table, index, at = [], [], [], 0
    plain, own = [], []

    def flush() -> None:
        nonlocal at
        if own:
            whole = b"".join(plain)
            packed = packer.compress(whole)
            table.append((len(packed), len(whole)))
            index.extend((len(table) - 1, at, len(packed), o, n) for o, n in own)
            out.append(packed)
            at += len(packed)
            plain.clear()
            own.clear()

    held = 0
    for r in records:
        own.append((held, len(r)))
        plain.append(r)
        held += len(r)
        if held >= frame_bytes:
            flush()
            held = 0
    flush()
    seek = b"".join(struct.pack("<II", *x) for x in table) + struct.pack("<IBI", len(table), 0, SEEKABLE)
    return b"".join(out) + struct.pack("<II", SKIPPABLE, len(seek)) + seek, index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Of a bundle: each frame's place, packed size and plain size, read from its end."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def write(decided: DataFrame, to: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles and returns the record index (a written table).

    A task bundles its rows in a total order (by page, and rows alike in that by all the
    rest), so that a task that is run again writes the same files, and the index that is
    kept agrees with them whichever attempt wrote last.
    """
    shared.make(decided.sparkSession, to)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            file = f"pages-{part:06d}-{k:04d}.warc.zst"
            data, index = bundle((r for r in [info(file, date), *(r for _, r in rows)]), frame_bytes, level)
            shared.put(f"{to}/{file}", data)
            frame, at, packed, offset, length = map(list, zip(*index[1:]))
            return pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([file] * len(rows)), pa.array(frame, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, packed, offset, length))], names=["page_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "bytes", "refers_to"))):
                rows.append((row[0], record(*row, date)))
                held += len(rows[-1][1])
                if held >= bundle_bytes:
                    yield flush()
                    rows, held, k = [], 0, k + 1
        if rows:
            yield flush()

    rows = decided.select("page_id", "url", "payload", "digest", "bytes", "refers_to").sortWithinPartitions("page_id", "digest", "url", "refers_to")
    return shared.cut(rows.mapInArrow(work, INDEX), "warc-index")


def read(spark: SparkSession, at: str) -> DataFrame:
    """All records of the bundles in a folder, frame by frame."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        un = zstandard.ZstdDecompressor()
        for b in batches:
            for data in b.column("content"):
                data = data.as_py()
                for place, packed, _ in seek_table(data):
                    plain, pos, rows = un.decompress(data[place : place + packed]), 0, []
                    while pos < len(plain):
                        head, block, pos = parse(plain, pos)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
                        (size, payload), revisit = http(block), head["WARC-Type"] == "revisit"
                        url = head["WARC-Target-URI"]
                        rows.append((number(head["WARC-Record-ID"]), size if revisit else len(payload), head["WARC-Payload-Digest"][5:] if revisit else hashlib.sha1(payload).hexdigest(), head["WARC-Type"], number(head.get("WARC-Refers-To")), None if f"<{url}>" == head["WARC-Record-ID"] else url, None if revisit else payload))
                    if not rows:
                        continue
                    cols = list(zip(*rows))
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.int64()), pa.array(cols[5]), pa.array(cols[6], pa.binary())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(at)
    return files.select("content").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def fetch(at: str, row: dict) -> tuple[dict, bytes]:
    """Headers and payload of one record by its index row: reads and unpacks its frame only."""
    import zstandard
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{at}/{row['bundle']}")
    with store.open_input_file(path) as f:
        f.seek(row["frame_at"])
        plain = zstandard.ZstdDecompressor().decompress(f.read(row["frame_bytes"]))
    head, block, _ = parse(plain[row["offset"] : row["offset"] + row["length"]])
    return head, http(block)[1]
