"""Structured Streaming jobs; each transformation also runs on a batch frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_counts(df: DataFrame, time: str, kind: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind; a stream is watermarked, so it can append closed windows."""
    d = df.withWatermark(time, late) if df.isStreaming else df
    return d.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select("window.start", "window.end", kind, "n")


def latest_state(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Newest value of each key, for update or complete mode."""
    return df.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def dedup(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Replayed ids dropped, across batches while the watermark holds them."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def rate_demand(df: DataFrame, key: str, time: str, seconds: int = 60, slide: int = 10) -> DataFrame:
    """Requests of each key by sliding window."""
    d = df.withWatermark(time, f"{seconds} seconds") if df.isStreaming else df
    return d.groupBy(F.window(time, f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def rate_batch(df: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """Adds n_last: the key's requests in (t - seconds, t]."""
    us = F.unix_micros(time)
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("n_last", F.count("*").over(w))


def rate_verdict(df: DataFrame, key: str, time: str, seq: str, limit: int, seconds: int = 60) -> DataFrame:
    """Adds allowed: a request passes if fewer than `limit` allowed ones lie in (t - seconds, t]; denied ones do not count.

    The verdict depends on earlier verdicts of the key, so it runs over the key's
    ordered rows, in Arrow batches; a key's rows stay in order in one partition.
    """
    cols = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", allowed boolean"

    def work(batches):
        from collections import deque

        last, kept = object(), deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[time].astype("int64")):
                if k != last:
                    last, kept = k, deque()
                while kept and kept[0] <= t - seconds * 1_000_000_000:
                    kept.popleft()
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                out.append(ok)
            pdf["allowed"] = out
            yield pdf[[*cols, "allowed"]]

    d = df.withColumn(time, F.col(time).cast("timestamp"))
    return d.repartition(key).sortWithinPartitions(key, time, seq).mapInPandas(work, schema)


def stale_sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Heartbeat sessions of each key: a closed one means a lost lease."""
    d = df.withWatermark(time, gap) if df.isStreaming else df
    return d.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh_rows(rows: DataFrame, target: str, key: str, buckets: int) -> DataFrame:
    """Rows whose key the target lacks, with their bucket; only the buckets that the rows fall in are read, and of those the keys."""
    spark = rows.sparkSession
    b = rows.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if not _exists(spark, target):
        return b
    own = [r[0] for r in b.select("_bucket").distinct().collect()]  # `buckets` numbers at most
    known = spark.read.parquet(target).where(F.col("_bucket").isin(own)).select(F.col("_bucket").alias("_kb"), F.col(key).alias("_k"))
    return b.join(known, (F.col("_bucket") == F.col("_kb")) & (F.col(key) == F.col("_k")), "left_anti")


def ingest(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str, buckets: int = 64):
    """Appends prepared rows that the target lacks, batch by batch; a replayed batch adds nothing.

    The target is partitioned by a hash of the key (`_bucket`), and a batch reads only the
    buckets that it has rows for.  The number of buckets is the table's and must not change.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.sparkSession.createDataFrame([], prepare(batch).schema) if batch.isEmpty() else prepare(batch)
        fresh_rows(rows, target, key, buckets).write.mode("append").partitionBy("_bucket").parquet(target)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_events(stream: DataFrame, time: str, kind: str, seconds: int, late: int, target: str, checkpoint: str):
    """Events by tumbling window and kind, batch by batch, with those that came too late counted apart.

    An event is late if its window had ended by the watermark that the batches before left
    (the greatest time in them, less `late` seconds), which is when a stream would have
    closed and dropped it.  Each batch is a folder of the target, so a replayed one
    replaces itself; window_counts() sums them up.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = None
        if _exists(spark, target):
            mark = spark.read.parquet(target).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        start = F.window(time, f"{seconds} seconds")["start"]
        end = F.unix_micros(start) + seconds * 1_000_000
        behind = F.lit(False) if mark is None else end <= F.unix_micros(F.lit(mark).cast("timestamp")) - late * 1_000_000
        n = batch.where(F.col(time).isNotNull()).groupBy(start.alias("start"), F.col(kind).alias("kind"), behind.alias("late")).agg(F.count("*").alias("n"), F.max(time).cast("timestamp").alias("newest"))
        n.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(spark, target: str) -> DataFrame:
    """start, kind, n and n_late of all batches: n is what a stream with the same watermark appends, n_late what it drops."""
    return spark.read.parquet(target).groupBy("start", "kind").agg(F.sum(F.when(F.col("late"), 0).otherwise(F.col("n"))).alias("n"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))
