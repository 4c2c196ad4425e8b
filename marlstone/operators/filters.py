"""Filters of many questions over many chunks: equal filters are met once, by equality of their values.

A filter is a set of lists (an empty one lets everything pass, else one of its values
must be the chunk's, without regard to case; of an array column any element counts), a
wish for current chunks only, and a range of publish times that chunks without a time
miss.  Questions with equal filters share a signature.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = {"any_source": "source", "any_kind": "kind"}


def _values(c: Column) -> Column:
    """Distinct lower-case values of a filter's list, in order; null is an empty list."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))))


def signatures(queries: DataFrame, query_id: str, lists: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, sig) of all questions, and the distinct filters: sig, the lists, current_only, q_start, q_end."""
    names = list(lists if lists is not None else LISTS)
    have = set(queries.columns)
    only = F.coalesce("current_only", F.lit(False)) if "current_only" in have else F.lit(False)
    bound = lambda c: F.col(c).cast("timestamp") if c in have else F.lit(None).cast("timestamp")
    q = queries.select(query_id, *[_values(F.col(c)).alias(c) for c in names], only.alias("current_only"), *[bound(c).alias(c) for c in ("q_start", "q_end")])
    rest = [c for c in q.columns if c != query_id]
    q = q.withColumn("sig", F.md5(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})))
    return q.select(query_id, "sig"), q.select("sig", *rest).dropDuplicates(["sig"])


def _keys(pattern: Sequence[bool], values: list[Column]) -> Column:
    """Every way to take one value of each list in the pattern, as text, behind the pattern itself."""

    def longer(keys: Column, values: Column) -> Column:
        return F.flatten(F.transform(keys, lambda k: F.transform(values, lambda x: F.concat(k, F.lit("\0"), x))))

    start = F.array(F.lit("".join("1" if x else "0" for x in pattern)))
    return reduce(longer, [v for used, v in zip(pattern, values) if used], start)


def match(chunks: DataFrame, sigs: DataFrame, lists: dict[str, str] | None = None, current: str = "is_current", published: str = "published") -> DataFrame:
    """sig and the chunk's columns for every filter that a chunk passes; chunks are read once and joined by equality alone."""
    lists = LISTS if lists is None else lists
    used = sigs.select(*[(F.size(c) > 0).alias(c) for c in lists]).distinct().collect()  # which lists are in use together: 2 ** len(lists) rows at most
    patterns = [tuple(r) for r in used]
    if not patterns:
        return chunks.where("false").select(F.lit("").alias("sig"), *chunks.columns)
    kinds = dict(chunks.dtypes)
    many = {c for c in lists.values() if kinds[c].startswith("array")}
    own = [F.array_compact(F.array_distinct(F.transform(F.col(c), lambda x: F.lower(x)))) if c in many else F.array_compact(F.array(F.lower(F.col(c)))) for c in lists.values()]
    c = chunks.select(F.struct(*chunks.columns).alias("_chunk"), F.array(*own).alias("_own"))
    # a null array holds no value
    value = [F.coalesce(F.get("_own", i), F.array().cast("array<string>")) for i in range(len(own))]
    c = c.withColumn("_key", F.explode(F.concat(*[_keys(p, value) for p in patterns])))
    s = sigs.select("sig", *lists, "current_only", "q_start", "q_end")
    pattern = lambda p: reduce(lambda a, b: a & b, [(F.size(n) > 0) == F.lit(x) for n, x in zip(lists, p)])
    key = reduce(lambda w, p: w.when(pattern(p), _keys(p, [F.col(n) for n in lists])), patterns[1:], F.when(pattern(patterns[0]), _keys(patterns[0], [F.col(n) for n in lists])))
    s = s.withColumn("_key", F.explode(key))
    j = c.join(s, "_key")
    # a chunk with several values of one list meets the filter several times: its first way counts
    parts = F.split("_key", "\0")
    for i, (n, col) in enumerate(lists.items()):
        if col in many:
            at = sum((F.size(m).cast("int") > 0).cast("int") for m in list(lists)[: i + 1])
            j = j.where((F.size(n) == 0) | (F.get(parts, at) == F.get(F.array_intersect(F.col(n), value[i]), 0)))
    ok = F.lit(True)
    if current in kinds:
        ok = ok & (~F.col("current_only") | F.coalesce(F.col(f"_chunk.{current}"), F.lit(False)))
    if published in kinds:
        at = F.col(f"_chunk.{published}").cast("timestamp")
        ranged = F.col("q_start").isNotNull() | F.col("q_end").isNotNull()
        ok = ok & (~ranged | (at.isNotNull() & F.coalesce(at >= F.col("q_start"), F.lit(True)) & F.coalesce(at <= F.col("q_end"), F.lit(True))))
    return j.where(ok).select("sig", "_chunk.*")


def metadata_filter(chunks: DataFrame, queries: DataFrame, query_id: str = "query_id", lists: dict[str, str] | None = None) -> DataFrame:
    """query and the chunk's columns for every chunk that passes a question's filter.

    queries: the columns of `lists` (arrays), and current_only, q_start, q_end where
    asked for; chunks: the columns that lists names, is_current, published.
    """
    asked, sigs = signatures(queries, query_id, lists)
    return match(chunks, sigs, lists).join(asked, "sig").drop("sig")
