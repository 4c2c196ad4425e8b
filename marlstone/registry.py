"""Registration of queries (a Spark job over the given tables) and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


WORDY = {"documents", "pages", "conversations", "embeddings"}  # tables whose rows take long, for their bytes
SPLIT_BYTES = 1 << 26


def spread(df):
    """A table too small to give every core a split of its own, dealt out row by row; a larger one as its files lie.

    A file is read by as many tasks as it has row groups, and a small one has one: all
    that is done to its rows would be done by a single core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def read(spark, sf_dir: str, name: str):
    """A given table; times without a zone are UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spread(df) if name in WORDY else df
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in plain}) if plain else df


def scratch(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/marlstone-{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """A table written to the shared folder and read back: its plan and its lineage end there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, table) -> DataFrame under its name; table(name) reads a given table."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir: str):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, lambda name: read(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
