"""The folder that driver and executors share, files in it, and bitmaps that thin out rows before a shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS, MOST_IDS = 26, 1 << 24
SKIP = 19  # an order of shingles by slots prefers some low and some high bits of their hashes; those in between are even


def folder(spark: SparkSession, name: str) -> str:
    """A new folder URI under spark.checkpoint.dir; where that is unset, a temporary folder of a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("marlstone.scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-marlstone-", dir="/tmp")
            spark.conf.set("marlstone.scratch", base)
    return f"{base.rstrip('/')}/marlstone-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that their lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    _written.append((df.sparkSession, path))
    return out


_written: list[tuple[SparkSession, str]] = []


def mark() -> int:
    """A point in time for release()."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Deletes the folders of all tables made by cut since a mark, but those of `keep`: for a step whose result is written."""
    kept = {t.written_at for t in keep}
    for spark, path in _written[since:]:
        if path not in kept:
            remove(spark, path)
    del _written[since:]
    _written.extend((t.sparkSession, t.written_at) for t in keep)


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by cut; for tables whose successors are written."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def make(spark: SparkSession, path: str) -> None:
    """Makes an empty folder, so that a table without rows can be read back."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put(uri: str, data: bytes) -> None:
    """One whole file: written under another name, then renamed, so that a retried task replaces it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def sieve(ids: DataFrame, col: str) -> np.ndarray | None:
    """A bitmap that holds every value of a column of hashes, and others by chance.

    It has 8 to 16 bits for each row, 2**MOST_BITS (8 MB) at most, and is put together by
    the executors.  Beyond MOST_IDS rows it would hold nearly everything: None then, and
    callers join instead.
    """
    n = ids.count()
    if n > MOST_IDS:
        return None
    bits = min(max((8 * n).bit_length(), 16), MOST_BITS)
    slot = F.shiftright(col, SKIP).bitwiseAND(F.lit((1 << bits) - 1))
    words = ids.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftright(`{col}`, {SKIP}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    for b in words.to_batches():
        out[np.asarray(b.column(0))] = np.asarray(b.column(1))
    return out.view(np.uint8)


def within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap holds."""
    slot = (h >> np.int64(SKIP)) & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def sift(d: DataFrame, bitmap: np.ndarray, col: str) -> DataFrame:
    """Rows of d whose hash in `col` the bitmap holds."""
    held, at = d.sparkSession.sparkContext.broadcast(bitmap), d.columns.index(col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(within(held.value, np.asarray(b.column(at)))))

    return d.mapInArrow(work, d.schema)


def matching(d: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of d whose `col` may be among those of ids, a written table: by bitmap while ids are few, else by a join."""
    bitmap = sieve(ids, col)
    return d.join(ids.select(col), col, "left_semi").select(d.columns) if bitmap is None else sift(d, bitmap, col)
