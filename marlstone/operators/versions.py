"""Versioned documents: deduplication, validity intervals, merges, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, key: list[str], time: str, seq: str) -> DataFrame:
    """Latest observation of each key; of equal times the later row."""
    w = Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def version_history(obs: DataFrame, entity: str, time: str, state: str, tie: str, declared: str | None = None) -> DataFrame:
    """Observations to versions: entity, state, version_no, first_seen, last_seen, n_seen, valid_from, valid_to, is_current.

    Equal consecutive states merge, a state that returns opens a new interval; one sort
    for each entity serves all windows.  With a `declared` start an entity's first version
    begins at the least of its declared starts where that is before it was seen.
    """
    w = Window.partitionBy(entity).orderBy(time, tie)
    o = obs.withColumn("_prev", F.lag(state).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    change = F.col("_first") | ~F.col(state).eqNullSafe(F.col("_prev"))
    o = o.withColumn("version_no", F.sum(F.when(change, 1).otherwise(0)).over(w))
    said = [F.min(declared).alias("_declared")] if declared else []
    v = o.groupBy(entity, "version_no").agg(F.min(state).alias(state), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n_seen"), *said)
    nxt = Window.partitionBy(entity).orderBy("version_no")
    start = F.when(F.col("version_no") == 1, F.least("_declared", "first_seen")).otherwise(F.col("first_seen")) if declared else F.col("first_seen")
    v = v.withColumn("valid_from", start).drop("_declared").withColumn("valid_to", F.lead("first_seen").over(nxt))
    return v.withColumn("is_current", F.col("valid_to").isNull())


def seen_metadata(obs: DataFrame, entity: str, version: str, time: str, raw: str, value: str) -> DataFrame:
    """Per version: first and last seen, distinct raw ids in order, newest non-null value."""
    g = obs.groupBy(entity, version).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.array_sort(F.collect_set(raw)).alias("raw_ids"), F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, raw))).alias("newest"))
    return g


def merge_report(old: DataFrame, new: DataFrame, key: str = "version_id") -> DataFrame:
    """One row: versions added, unchanged, superseded (were current and are not)."""
    j = old.select(F.col(key).alias("_o"), F.col("is_current").alias("_oc")).join(new.select(F.col(key).alias("_n"), F.col("is_current").alias("_nc")), F.col("_o") == F.col("_n"), "full_outer")
    return j.agg(F.count_if(F.col("_o").isNull()).alias("added"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("unchanged"), F.count_if(F.col("_oc") & F.col("_n").isNotNull() & ~F.coalesce("_nc", F.lit(False))).alias("superseded"))


def upsert_versions(old: DataFrame, incoming: DataFrame, entity: str, key: str = "version_id") -> DataFrame:
    """Adds unknown versions; a new current one closes the entity's open version at its start."""
    fresh = incoming.join(old.select(key), key, "left_anti")
    both = old.select(*old.columns).unionByName(fresh.select(*old.columns))
    w = Window.partitionBy(entity).orderBy("valid_from", key)
    nxt = F.lead("valid_from").over(w)
    both = both.withColumn("_next", nxt)
    return both.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("valid_to").isNull()).drop("_next")


def version_violations(df: DataFrame, entity: str, key: str = "version_id") -> DataFrame:
    """Duplicate version ids, and entities with more than one current version: kind, id, n."""
    dup = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_version").alias("kind"), "id", "n")
    cur = df.where("is_current").groupBy(F.col(entity).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("many_current").alias("kind"), "id", "n")
    return dup.unionByName(cur)


def corpus_stats(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts overall and by each column of `by`: scope, value, n and the measures; one pass by grouping sets."""
    d = df.select(*[F.col(c).cast("string").alias(c) for c in by], *[m.alias(k) for k, m in measures.items()])
    scope = reduce(lambda w, c: w.when(F.grouping(c) == 0, F.lit(c)), by[1:], F.when(F.grouping(by[0]) == 0, F.lit(by[0]))).otherwise("all")
    g = d.groupingSets([[], *[[c] for c in by]], *by).agg(scope.alias("scope"), F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in measures])
    return g.select("scope", F.coalesce(*by).alias("value"), "n", *measures)


def interval_checks(df: DataFrame, entity: str) -> DataFrame:
    """Findings: entity, finding for entities without exactly one current version, overlapping or open inner intervals."""
    w = Window.partitionBy(entity).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    d = df.withColumn("_next", F.lead("valid_from").over(w))
    overlap = d.where(F.col("_next").isNotNull() & F.col("valid_to").isNotNull() & (F.col("_next") < F.col("valid_to"))).select(entity, F.lit("overlap").alias("finding"))
    open_ = d.where(F.col("_next").isNotNull() & F.col("valid_to").isNull()).select(entity, F.lit("open_inner").alias("finding"))
    cur = df.groupBy(entity).agg(F.count_if("is_current").alias("_c")).where("_c <> 1").select(entity, F.lit("current_count").alias("finding"))
    return reduce(DataFrame.unionByName, [overlap, open_, cur]).distinct()


def as_of(df: DataFrame, instant: Column) -> DataFrame:
    """Rows whose half-open interval holds the instant; null bounds are open."""
    return df.where((F.col("valid_from").isNull() | (F.col("valid_from") <= instant)) & (F.col("valid_to").isNull() | (F.col("valid_to") > instant)))


def as_of_join(points: DataFrame, versions: DataFrame, entity: str, instant: str, columns: list[str]) -> DataFrame:
    """points with the `columns` of the entity's version that holds at their instant (nulls where none does).

    Versions and points go in one sort by entity and time, and each point looks back to
    the last version that began by then: one exchange, no inequality join.  Versions of
    an entity must not overlap (see interval_checks), as those of version_history do not;
    a null valid_from has always begun, a null valid_to never ends.  Points with a null
    entity or instant hold nothing; columns of both sides may have the same names.
    """
    held = F.struct(F.lit(True).alias("_is"), "valid_to", *columns)
    v = versions.select(F.col(entity).alias("_e"), F.col("valid_from").alias("_t"), held.alias("_v"), F.lit(None).cast(points.schema).alias("_p"))
    p = points.select(F.col(entity).alias("_e"), F.col(instant).alias("_t"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.struct(*points.columns).alias("_p"))
    # an interval is half open: at one instant the version comes first; of versions that begin together the one that ends last counts
    kind = F.col("_p").isNotNull().cast("int")
    w = Window.partitionBy("_e").orderBy(F.col("_t").asc_nulls_first(), kind, F.col("_v.valid_to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = v.unionByName(p).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_p is not null")
    holds = F.col("_e").isNotNull() & F.col("_t").isNotNull() & F.col("_last._is") & (F.col("_last.valid_to").isNull() | (F.col("_last.valid_to") > F.col("_t")))
    names = {c: f"{c}_at" if c in points.columns else c for c in columns}
    return at.select("_p.*", *[F.when(holds, F.col(f"_last.{c}")).alias(n) for c, n in names.items()])
