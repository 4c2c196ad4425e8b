"""Rate limits as a stream: a verdict for every request from keyed state with timers."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(allowed: list[int], at: int, limit: int, width: int) -> bool:
    """Whether a request passes: fewer than `limit` allowed ones in (at - width, at]; if so it is put among them.  Times ascend."""
    ok = bisect_right(allowed, at) - bisect_right(allowed, at - width) < limit
    if ok:
        insort(allowed, at)
    return ok


class RateLimiter(StatefulProcessor):
    """State of a key: the times (microseconds) of its allowed requests that a coming one can still see; a timer drops them."""

    def __init__(self, key: str, time: str, seq: str, columns: list[str], limit: int, seconds: int):
        self.key, self.time, self.seq, self.columns, self.limit, self.width = key, time, seq, columns, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.allowed = handle.getValueState("allowed", "times array<bigint>")

    def _held(self) -> list[int]:
        return list(self.allowed.get()[0]) if self.allowed.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.time, self.seq], kind="stable")
        times = self._held()
        at = pdf[self.time].astype("datetime64[us]").astype("int64")
        pdf["allowed"] = [verdict(times, t, self.limit, self.width) for t in at]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        times = times[bisect_right(times, mark - self.width) :]  # no request before the watermark comes any more
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if times:
            self.allowed.update((times,))
            self.handle.registerTimer((times[-1] + self.width) // 1000 + 1)
        elif self.allowed.exists():
            self.allowed.clear()
        yield pdf[[*self.columns, "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.allowed.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_stream(df: DataFrame, key: str, time: str, seq: str, limit: int, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """A stream's rows with `allowed`: a request passes if fewer than `limit` allowed ones of its key lie in (t - seconds, t].

    Denied requests do not count.  Requests of a batch are judged by time and `seq`; across
    batches in the order in which they come, so verdicts equal rate_verdict's where files
    follow one another in time.  Rows behind the watermark (`late`) are dropped by Spark.
    A key's state goes `seconds` after its last allowed request has left the watermark.
    The session needs the RocksDB state store, which is set where nothing is.
    """
    spark = df.sparkSession
    if ROCKS != spark.conf.get(STORE, None):
        spark.conf.set(STORE, ROCKS)
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    schema = ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + ", allowed boolean"
    return d.groupBy(key).transformWithStateInPandas(RateLimiter(key, time, seq, d.columns, limit, seconds), schema, "Append", "EventTime")
