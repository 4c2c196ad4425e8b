"""Rule labels: event by source, dimensions by keywords, confidence, reasons, two labelers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords


def event_by_source(df: DataFrame, source: str, events: DataFrame) -> DataFrame:
    """Adds `event_type` from a table (source, event_type); sources not in it have none."""
    return df.join(F.broadcast(events.withColumnRenamed("source", "_s")), F.col(source) == F.col("_s"), "left").drop("_s")


def tag_dimensions(hits: Column, rules: dict[str, list[str]]) -> dict[str, Column]:
    """For each dimension the array of its terms among the hits (see keywords.occurrences), in rule order."""
    return {d: keywords.held(hits, terms) for d, terms in rules.items()}


def label(df: DataFrame, text: Column, rules: dict[str, list[str]], event: str = "event_type", threshold: float = 0.55) -> DataFrame:
    """Adds dimension_tags, n_matches, confidence, needs_review and reasons; all terms are met in one pass over the text."""
    found = df.withColumn("_hits", keywords.occurrences(F.lower(text), [t for ts in rules.values() for t in ts], tokens=True))
    out = found.withColumns({f"_m_{d}": c for d, c in tag_dimensions(F.col("_hits"), rules).items()}).drop("_hits")
    have = lambda d: F.size(f"_m_{d}") > 0
    out = out.withColumn("dimension_tags", F.array_compact(F.array(*[F.when(have(d), F.lit(d)) for d in rules])))
    out = out.withColumn("n_matches", sum((F.size(f"_m_{d}") for d in rules), F.lit(0)).cast("long"))
    dims = F.size("dimension_tags")
    score = F.least(F.lit(0.95), 0.52 + 0.08 * F.least(F.col("n_matches"), F.lit(4)) + 0.03 * F.least(dims - 1, F.lit(3)))
    out = out.withColumn("confidence", F.when(dims == 0, F.when(F.col(event).isNotNull(), 0.35).otherwise(0.0)).otherwise(score))
    out = out.withColumn("needs_review", (dims == 0) | (F.col("confidence") < threshold))
    why = [F.when(have(d), F.concat(F.lit(f"{d}:keywords="), F.concat_ws(",", F.slice(f"_m_{d}", 1, 5)))) for d in rules]
    source = F.when(F.col(event).isNotNull(), F.concat(F.lit("source->"), F.col(event)))
    return out.withColumn("reasons", F.concat_ws(";", source, *why)).drop(*[f"_m_{d}" for d in rules])


def reconcile(a: DataFrame, b: DataFrame, key: str = "doc_id", strategy: str = "consensus") -> DataFrame:
    """Two labelers' tags and confidences (tags, confidence) side by side, merged."""
    j = a.select(key, F.col("tags").alias("_a"), F.col("confidence").alias("_ca"), F.lit(True).alias("_ha")).join(b.select(F.col(key).alias("_k"), F.col("tags").alias("_b"), F.col("confidence").alias("_cb"), F.lit(True).alias("_hb")), F.col(key) == F.col("_k"), "full_outer")
    none = F.array().cast("array<string>")
    j = j.withColumns({key: F.coalesce(key, "_k"), "_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    agree = F.array_sort("_a") == F.array_sort("_b")
    merged = F.array_intersect("_a", "_b") if strategy == "consensus" else F.array_union("_a", "_b")
    low = F.least(F.coalesce("_ca", F.lit(0.0)), F.coalesce("_cb", F.lit(0.0)))
    mean = (F.coalesce("_ca", F.lit(0.0)) + F.coalesce("_cb", F.lit(0.0))) / 2
    return j.select(key, merged.alias("tags"), F.array_except("_a", "_b").alias("only_first"), F.array_except("_b", "_a").alias("only_second"), agree.alias("agree"), F.when(agree, mean).otherwise(0.8 * low).alias("confidence"), (~agree | (F.size(merged) == 0)).alias("needs_review"))
