"""Retrieval metrics over tables of results and gold grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_precision(results: DataFrame, gold: DataFrame, case: str, item: str, k: int) -> DataFrame:
    """case, recall, precision: distinct hits in the first k over relevant, and over distinct retrieved."""
    top = results.where(F.col("rank") <= k).select(case, item).distinct()
    rel = gold.select(case, item).distinct().withColumn("_g", F.lit(1))
    got = top.join(rel, [case, item], "left").groupBy(case).agg(F.count("*").alias("n_got"), F.count("_g").alias("n_hit"))
    return rel.groupBy(case).agg(F.count("*").alias("n_rel")).join(got, case, "left").select(case, F.coalesce(F.col("n_hit") / F.col("n_rel"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("n_hit") / F.col("n_got"), F.lit(0.0)).alias("precision"))


def reciprocal_rank(results: DataFrame, gold: DataFrame, case: str, item: str) -> DataFrame:
    first = results.join(gold.select(case, item).distinct(), [case, item]).groupBy(case).agg(F.min("rank").alias("_r"))
    return gold.select(case).distinct().join(first, case, "left").select(case, F.coalesce(1 / F.col("_r"), F.lit(0.0)).alias("rr"))


def ndcg(results: DataFrame, gold: DataFrame, case: str, item: str, k: int, grade: str = "grade", dedup: bool = False) -> DataFrame:
    """Gain 2^g - 1, log2 discount, ideal from all grades; repeated ids count each time unless dedup."""
    if dedup:
        results = results.groupBy(case, item).agg(F.min("rank").alias("rank"))
    part = lambda r: (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(r) + 1)
    dcg = results.where(F.col("rank") <= k).join(gold, [case, item]).groupBy(case).agg(F.sum(part("rank")).alias("_d"))
    best = gold.withColumn("_n", F.row_number().over(Window.partitionBy(case).orderBy(F.col(grade).desc(), item))).where(F.col("_n") <= k)
    ideal = best.groupBy(case).agg(F.sum(part("_n")).alias("_i"))
    return ideal.join(dcg, case, "left").select(case, F.when(F.col("_i") > 0, F.coalesce("_d", F.lit(0.0)) / F.col("_i")).otherwise(0.0).alias("ndcg"))


def share(results: DataFrame, case: str, ok) -> DataFrame:
    """Share of a case's results that meet a condition."""
    return results.groupBy(case).agg(F.avg(ok.cast("double")).alias("share"))


def conflict_prf(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall, f1, exact_match over distinct keys, with the empty-set conventions."""
    p, e = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    c = p.join(e, keys, "full_outer").agg(F.count("_p").alias("np"), F.count("_e").alias("ne"), F.count_if(F.col("_p").isNotNull() & F.col("_e").isNotNull()).alias("hit"))
    pr = F.when((F.col("np") == 0) & (F.col("ne") == 0), 1.0).when(F.col("np") == 0, 0.0).otherwise(F.col("hit") / F.col("np"))
    re_ = F.when((F.col("np") == 0) & (F.col("ne") == 0), 1.0).when(F.col("ne") == 0, 0.0).otherwise(F.col("hit") / F.col("ne"))
    c = c.select(pr.alias("precision"), re_.alias("recall"), ((F.col("hit") == F.col("np")) & (F.col("hit") == F.col("ne"))).alias("exact_match"))
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, p50, p95 (linear interpolation), max; zeros when empty."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(z(F.avg(value)).alias("mean"), z(F.percentile(value, 0.5)).alias("p50"), z(F.percentile(value, 0.95)).alias("p95"), z(F.max(value)).alias("max"))


def aggregate_runs(df: DataFrame, by: list[str], value: str, invariants: str | None = None) -> DataFrame:
    """mean, sample deviation (0 for one run), min, max, n, and whether the runs share their invariants."""
    same = (F.countDistinct(invariants) <= 1) if invariants else F.lit(True)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"), same.alias("consistent"))


def candidate_pool(groups: dict[str, DataFrame], seeds: DataFrame, case: str, item: str, n: int) -> DataFrame:
    """Union of the first n of several rankings and forced seeds: best_rank, n_groups, seeded, position."""
    from functools import reduce

    parts = [r.where(F.col("rank") <= n).select(case, item, F.lit(g).alias("g"), "rank", F.lit(False).alias("s")) for g, r in groups.items()]
    parts.append(seeds.select(case, item, F.lit(None).cast("string").alias("g"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("s")))
    u = reduce(DataFrame.unionByName, parts).groupBy(case, item).agg(F.max("s").alias("seeded"), F.min("rank").alias("best_rank"), F.countDistinct("g").alias("n_groups"))
    w = Window.partitionBy(case).orderBy(F.col("seeded").desc(), F.coalesce("best_rank", F.lit(1_000_000_000)), item)
    return u.withColumn("position", F.row_number().over(w))


def round_robin(df: DataFrame, strata: list[str], id_col: str, n: int) -> DataFrame:
    """One row of each stratum in turn until n."""
    d = df.withColumn("_round", F.row_number().over(Window.partitionBy(*strata).orderBy(id_col)))
    return d.orderBy("_round", *strata, id_col).limit(n)


def case_violations(cases: DataFrame, filters: list[str]) -> DataFrame:
    """case_id, violation rows.  cases: case_id, relevant (array of ids), filters (array of names), grades (map of id to grade, or null).

    no_cases (with a null case_id: the table is empty), duplicate_case, no_relevant,
    unknown_filter, bad_grade (null, not finite or negative), relevant_without_grade (a case
    with grades has a relevant id without a positive one).
    """
    c = F.col
    grades = F.map_values("grades")
    graded = c("grades").isNotNull() & (F.size("grades") > 0)
    own = F.array(
        F.when(F.coalesce(F.size("relevant"), F.lit(0)) <= 0, "no_relevant"),
        F.when(F.exists(F.coalesce("filters", F.array().cast("array<string>")), lambda x: ~x.isin(*filters)), "unknown_filter"),
        F.when(graded & F.exists(grades, lambda g: g.isNull() | F.isnan(g) | (g < 0) | (g == float("inf"))), "bad_grade"),
        F.when(graded & F.exists("relevant", lambda x: ~(F.coalesce(F.try_element_at("grades", x), F.lit(0.0)) > 0)), "relevant_without_grade"),
    )
    each = cases.select("case_id", F.explode(F.array_compact(own)).alias("violation"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("_n")).where("_n > 1").select("case_id", F.lit("duplicate_case").alias("violation"))
    none = cases.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.lit("no_cases").alias("violation"))
    return each.distinct().unionByName(twice).unionByName(none)
