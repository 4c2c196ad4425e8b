"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed digest of their id, passes follow one
another, and an entry's virtual finish time is the source's words so far (itself
included) divided by the source's target.  All entries are ordered by finish time and
the order is cut where the total budget is reached.

Defined cases: null texts have size 0 and are never taken; a null source is a source of
its own, last in order; repeated rows count as documents of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, n_docs, weight, target.

    Targets share the total by weight; one above `most` times its source's size stops
    there, and what is left is shared anew until none is above.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights)).cast("double"))
    per = shared.cut(per, "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round fixes at least one more source, and needs two numbers only
        full = F.col("weight") * level >= most * F.col("source_size")
        got = per.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if got["open"] is None:
            break
        new = max(0.0, total - (got["fixed"] or 0.0)) / got["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")))


def mix(sized: DataFrame, per: DataFrame, seed: int = 7, passes: int = 3, bucket_docs: int = 4096, grid: int = 4096) -> DataFrame:
    """Every entry of the mix: doc_id, source, size, pass, finish, taken (words).

    Running sums are taken in two levels (buckets of the shuffled order, then rows
    of a bucket), so that no task needs a whole source or the whole mix.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(16**13)
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    own = per.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s"), "source_size", "n_docs", "target")
    d = sized.withColumn("_s", src).withColumn("_u", u).join(own, "_s")
    d = d.withColumn("_b", F.floor(F.col("_u") * F.ceil(F.col("n_docs") / bucket_docs)).cast("long"))
    d = shared.cut(d, "mix")
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = d.groupBy("_s", "_b").agg(F.sum("size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inner = Window.partitionBy("_s", "_b").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(buckets.drop("_n"), ["_s", "_b"]).withColumn("_cum", F.col("_before") + F.sum("size").over(inner))
    e = d.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    e = e.where("size > 0 and target > 0").withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("_cum")) / F.col("target"))
    return fill(e.select("doc_id", "source", "size", "source_size", "n_docs", "target", "pass", "finish", "_s", "_b"))


def fill(entries: DataFrame) -> DataFrame:
    """Gives entries behind a source's target, in their order, the room that one too long left before it.

    Rounds over all that is behind the targets: a round takes, for each source, entries
    that fit by themselves as long as their running sum fits, and the room shrinks, until
    no entry fits.  Running sums are taken by buckets first, so only rows of the buckets
    that the room reaches are summed one by one.  Entries so taken finish at 1.
    """
    c = F.col
    used = entries.where("finish <= 1").groupBy(c("_s").alias("_us")).agg(F.sum("size").alias("_used"))
    room = entries.groupBy("_s", "target").agg(F.count("*")).join(used, c("_s") == c("_us"), "left").select(c("_s").alias("_rs"), (c("target") - F.coalesce("_used", F.lit(0))).alias("_room"))
    late = shared.cut(entries.where("finish > 1").select("_s", "pass", "_b", "finish", "doc_id", "size"), "late")  # read in every round
    room, got = shared.cut(room, "room"), None
    key = ("_s", "pass", "_b", "finish", "doc_id", "size")
    before = Window.partitionBy("_s").orderBy("pass", "_b").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_s", "pass", "_b").orderBy("finish", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        fits = late.join(room, c("_s") == c("_rs")).where(c("size") <= c("_room")).drop("_rs")
        if got is not None:
            fits = fits.join(got.select(*[c(x).alias("g" + x) for x in key]), (c("_s") == c("g_s")) & (c("pass") == c("gpass")) & (c("_b") == c("g_b")) & (c("finish") == c("gfinish")) & c("doc_id").eqNullSafe(c("gdoc_id")), "left_anti")
        cells = fits.groupBy("_s", "pass", "_b").agg(F.sum("size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        near = fits.join(cells, ["_s", "pass", "_b"]).where(c("_before") < c("_room"))
        new = shared.cut(near.withColumn("_run", c("_before") + F.sum("size").over(inner)).where(c("_run") <= c("_room")).select(*key), "filled")
        if new.isEmpty():
            break
        got = new if got is None else shared.cut(got.unionByName(new), "filled")
        spent = new.groupBy(c("_s").alias("_us")).agg(F.sum("size").alias("_spent"))
        room = shared.cut(room.join(spent, c("_rs") == c("_us"), "left").select("_rs", (c("_room") - F.coalesce("_spent", F.lit(0))).alias("_room")), "room")
    if got is not None:
        early = got.select(*[c(x).alias("g" + x) for x in key]).distinct()
        entries = entries.join(early, (c("_s") == c("g_s")) & (c("pass") == c("gpass")) & (c("_b") == c("g_b")) & (c("finish") == c("gfinish")) & c("doc_id").eqNullSafe(c("gdoc_id")), "left")
        entries = entries.withColumn("finish", F.when(c("g_s").isNotNull(), F.lit(1.0)).otherwise(c("finish"))).drop(*["g" + x for x in key])
    # a document whose service would only begin past the target is not queued at all
    return entries.where((c("finish") <= 1) | (c("finish") - c("size") / c("target") < 1)).drop("_b", "n_docs")


def cut_at_budget(entries: DataFrame, budget: float, grid: int = 4096) -> DataFrame:
    """The entries that end within the budget, in order of (finish, source, doc_id, pass).

    The crossing point is found on a grid of finish times, then on a finer grid inside
    the crossing cell, then by a running sum over the rows of one fine cell.
    """
    low, width, used = 0.0, 1.0, 0
    cells = entries.withColumn("_c", F.lit(0))
    whole = F.lit(False)
    for _ in range(2):
        step = width / grid
        # cells at and past the grid's end meet in one: they come after every other
        c = F.least(F.floor((F.col("finish") - low) / step), F.lit(grid * 2)).cast("int")
        inside = entries.where((F.col("finish") >= low) & (F.col("finish") < low + width * 2))
        sums = sorted((r["c"], r["n"]) for r in inside.groupBy(c.alias("c")).agg(F.sum("size").alias("n")).collect())
        cross = None
        for k, n in sums:
            if used + n > budget:
                cross = k
                break
            used += n
        if cross is None:
            return entries.where(F.col("finish") < low + width * 2).drop("_s")
        low, width = low + cross * step, step / 2
    w = Window.partitionBy(F.lit(0)).orderBy("finish", "_s", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)
    edge = entries.where((F.col("finish") >= low) & (F.col("finish") < low + width * 2)).withColumn("_run", F.sum("size").over(w)).where(F.col("_run") <= budget - used)
    return entries.where(F.col("finish") < low).unionByName(edge.drop("_run")).drop("_s")


def mixture(docs: DataFrame, budget_share: float = 1.0, **names) -> DataFrame:
    """The mix itself in its order: doc_id, source, size, pass, finish, position-sorted by finish."""
    sized = shared.cut(sizes(docs, **names), "sizes")
    per = targets(sized)
    total = sized.agg(F.sum("size")).first()[0] or 0
    return cut_at_budget(mix(sized, per), total * budget_share).orderBy("finish", "source", "doc_id", "pass")


def taken(docs: DataFrame, **names) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, passes."""
    sized = shared.cut(sizes(docs, **names), "sizes")
    per = targets(sized)
    total = sized.agg(F.sum("size")).first()[0] or 0
    entries = mix(sized, per)
    got = cut_at_budget(entries, total).groupBy("doc_id", "source", "size").agg(F.sum("size").alias("_t"))
    # repeated rows have equal (doc_id, source, size): their words are shared out evenly
    same = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_k"))
    share = same.join(got.select(F.col("doc_id").alias("_d"), F.col("source").alias("_o"), F.col("size").alias("_z"), "_t"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_o")) & (F.col("size") == F.col("_z")), "left").drop("_d", "_o", "_z")
    own = per.select(F.col("source").alias("_o"), "source_size", "target")
    out = share.join(own, F.col("source").eqNullSafe(F.col("_o"))).drop("_o")
    # the j-th of k equal rows takes whole copies: floor and remainder of the copies
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("_t"), F.lit(0)) / F.col("size")).otherwise(0).cast("long")
    out = out.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).withColumn("passes", F.floor(copies / F.col("_k")) + F.when(F.col("_j") <= copies % F.col("_k"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("passes") * F.col("size")).cast("long").alias("taken"), F.col("passes").cast("long").alias("passes"))
