"""Published tables: a new version is written beside the others, checked, and made current by one renamed manifest.

A table's folder has `data/<version>-<id>` for each build and `manifests/<n>.json` for
each published one.  The manifest with the greatest number is current; it names the data
folder, the rows and a digest of the schema, so that every session on the store reads
the same version, and a build that failed or was never finished leaves nothing behind it
that a reader looks at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class NotPublished(Exception):
    """A build that did not become current, and why."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """A new file of this name and content, by rename; False if there is one already."""
    fs, at = _files(spark, path)
    part = _files(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")[1]
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(at) and fs.rename(part, at):
        return True
    fs.delete(part, False)
    return False


def digest(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """All manifests of a table, oldest first: number, version, data, rows, schema, schema_sha256."""
    fs, at = _files(spark, f"{root}/manifests")
    if not fs.exists(at):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(at))
    names = [x for x in names if x.endswith(".json")]
    if not names:
        return []
    rows = spark.read.option("wholetext", "true").text([f"{root}/manifests/{x}" for x in names]).collect()  # one short row for each version
    return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["number"])


def current(spark: SparkSession, root: str) -> dict | None:
    found = manifests(spark, root)
    return found[-1] if found else None


def read(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or the newest manifest's of a named one."""
    found = [m for m in manifests(spark, root) if version in (None, m["version"])]
    if not found:
        raise NotPublished(f"{root} has no published version" + (f" {version}" if version else ""))
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(found[-1]["schema"])).parquet(f"{root}/data/{found[-1]['data']}")


def publish(df: DataFrame, root: str, version: str, rows: int | None = None, least_share: float = 0.0, same_schema: bool = True, check: Callable[[DataFrame], int] | None = None) -> dict:
    """Writes a build and makes it current if it is clean; the manifest.  Else NotPublished, and the current version stays.

    Clean: as many rows as were written (and as `rows` says), at least `least_share` of
    the current version's, the same schema as that (with same_schema), and no findings of
    `check`, which counts them over the rows as they can be read back.
    """
    spark = df.sparkSession
    before = current(spark, root)
    data = f"{version}-{uuid.uuid4().hex[:12]}"
    path, seen = f"{root}/data/{data}", Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        written, found = seen.get["n"], back.count()
        why = None
        if found != written:
            why = f"{written} rows were written and {found} can be read"
        elif rows is not None and found != rows:
            why = f"{found} rows, not {rows}"
        elif before and found < least_share * before["rows"]:
            why = f"{found} rows after {before['rows']}"
        elif before and same_schema and before["schema_sha256"] != digest(df):
            why = "the schema is another one"
        elif check is not None and (n := check(back)):
            why = f"{n} findings"
        if why:
            raise NotPublished(f"{version}: {why}")
        m = {"number": before["number"] + 1 if before else 1, "version": version, "data": data, "rows": found, "schema": json.loads(df.schema.json()), "schema_sha256": digest(df)}
        _files(spark, f"{root}/manifests")[0].mkdirs(_files(spark, f"{root}/manifests")[1])
        if not _put(spark, f"{root}/manifests/{m['number']:08d}.json", json.dumps(m)):
            raise NotPublished(f"{version}: another build became version number {m['number']} meanwhile")
    except BaseException:
        fs, at = _files(spark, path)
        fs.delete(at, True)
        raise
    return m


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the newest `keep` published versions; how many."""
    old = manifests(spark, root)[:-keep] if keep else manifests(spark, root)
    for m in old:
        for p in (f"{root}/manifests/{m['number']:08d}.json", f"{root}/data/{m['data']}"):
            fs, at = _files(spark, p)
            fs.delete(at, True)
    return len(old)
