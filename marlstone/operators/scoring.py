"""Event cards, dimension scores, snapshots, comparison matrices and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of the seven dimensions, evidence levels and run components
DIMENSION_WEIGHTS = {"D1": 0.20, "D2": 0.18, "D3": 0.12, "D4": 0.10, "D5": 0.10, "D6": 0.12, "D7": 0.18}
LEVEL_WEIGHTS = {"A": 1.00, "B": 0.82, "C": 0.62, "D": 0.36}
FRESHNESS = ((30, 1.00), (90, 0.85), (180, 0.65))
OLDEST = 0.45


def lookup(c: Column, table: dict, otherwise=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def level_weight(c: Column) -> Column:
    return lookup(c, LEVEL_WEIGHTS, 0.0)


def freshness_weight(published: Column, as_of: Column) -> Column:
    """Weight by age band in whole days; unknown counts as the oldest."""
    age = F.greatest(F.datediff(as_of, published), F.lit(0))
    out = None
    for most, w in FRESHNESS:
        out = F.when(age <= most, w) if out is None else out.when(age <= most, w)
    return out.otherwise(OLDEST)


def cluster_events(evidence: DataFrame, request: str, cluster: list[str], most: int) -> DataFrame:
    """Clusters of a request in order of their best rank, the first `most`, with the number dropped."""
    g = evidence.groupBy(request, *cluster).agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_chunks"))
    g = g.withColumn("cluster_no", F.row_number().over(Window.partitionBy(request).orderBy("best_rank", *cluster)))
    total = F.count("*").over(Window.partitionBy(request))
    return g.withColumn("n_dropped", F.greatest(total - most, F.lit(0))).where(F.col("cluster_no") <= most)


def card_confidence(evidence: DataFrame, cards: DataFrame, card: str, level: str, chunk: str) -> DataFrame:
    """min(.95, .24 + .55 mean level weight + .045 min(chunks, 5)), .12 without evidence; one row for every card."""
    g = evidence.groupBy(card).agg(F.avg(level_weight(F.col(level))).alias("_w"), F.countDistinct(chunk).alias("n_chunks"))
    score = F.least(F.lit(0.95), 0.24 + 0.55 * F.col("_w") + 0.045 * F.least(F.col("n_chunks"), F.lit(5)))
    return cards.select(card).join(g, card, "left").select(card, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("_w").isNull(), 0.12).otherwise(score).alias("confidence"))


def card_priority(df: DataFrame, latest: Column, as_of: Column, confidence: Column, overlap: Column, focus: int, impact: float = 0.68) -> DataFrame:
    """Urgency, relevance, priority score and alert band; as_of is explicit and ages are whole days."""
    days = F.greatest(F.datediff(as_of, latest), F.lit(0))
    urgency = F.when(latest.isNull(), 0.5).when(days <= 30, 0.95).when(days <= 120, 0.72).otherwise(0.45)
    relevance = F.least(F.lit(1.0), 0.35 + 0.65 * overlap / max(focus, 1))
    raw = 35 * F.lit(impact) + 25 * urgency + 20 * confidence + 20 * relevance
    d = df.withColumn("urgency", urgency).withColumn("relevance", relevance)
    d = d.withColumn("priority", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(raw, 6), 0).cast("int"))))
    alert = F.when(F.col("priority") >= 80, "red").when(F.col("priority") >= 60, "orange").when(F.col("priority") >= 40, "yellow").otherwise("blue")
    return d.withColumn("alert", alert)


def magnitude(impact: float, confidence: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(F.round(impact * confidence * 10, 6), 0).cast("int")))


def evidence_contributions(rows: DataFrame, keys: list[str], weight: str, size: str, card: str) -> DataFrame:
    """One row for each key, the one with the greatest (weight, magnitude, card)."""
    w = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(size).desc(), F.col(card).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence_score(contributions: DataFrame, keys: list[str], weight: str, signed: str, source: str) -> DataFrame:
    """50 + 4 * weighted mean of signed magnitudes, clamped, and its confidence."""
    c = contributions.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(signed)).alias("_s"), F.sum(weight).alias("_w"), F.avg(weight).alias("_a"), F.count("*").alias("n_evidence"), F.countDistinct(source).alias("n_sources"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 4 * F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(0.0)))
    volume, variety = F.least(F.lit(1.0), 0.45 + 0.12 * F.col("n_evidence")), F.least(F.lit(1.0), 0.75 + 0.08 * F.col("n_sources"))
    return c.select(*keys, "n_evidence", "n_sources", score.alias("evidence_score"), F.least(F.lit(0.96), F.col("_a") * volume * variety).alias("evidence_confidence"))


def run_score(success: Column, tests: Column, compiled: Column, edits: Column, harmful: Column) -> Column:
    """Weighted success, tests and (where known) compile share, less capped edit and harm penalties, 0..100."""
    with_compile = 0.55 * success + 0.30 * tests + 0.15 * compiled
    raw = 100 * F.when(compiled.isNull(), (0.55 * success + 0.30 * tests) / 0.85).otherwise(with_compile)
    raw = raw - F.least(F.lit(16.0), 2.0 * edits) - F.when(harmful, 30.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def benchmark_score(runs: DataFrame, tasks: DataFrame, product: str, task: str, dimension: str, score: str) -> DataFrame:
    """Per product and dimension: mean run score and confidence by task coverage and repeats.  tasks: task, dimension."""
    n = tasks.groupBy(dimension).agg(F.countDistinct(task).alias("_tasks"))
    g = runs.join(tasks.select(task, dimension).distinct(), task).groupBy(product, dimension).agg(F.avg(score).alias("benchmark_score"), F.countDistinct(task).alias("_c"), F.count("*").alias("n_runs"))
    conf = F.least(F.lit(0.98), F.col("_c") / F.col("_tasks") * F.least(F.lit(1.0), 0.65 + 0.08 * F.col("n_runs")))
    return g.join(n, dimension).select(product, dimension, "benchmark_score", "n_runs", conf.alias("benchmark_confidence"))


def dimension_score(ev: DataFrame, be: DataFrame, keys: list[str]) -> DataFrame:
    """.6 evidence + .4 benchmark over what is there; insufficient if neither."""
    j = ev.join(be, keys, "full_outer")
    we, wb = F.when(F.col("evidence_score").isNotNull(), 0.6).otherwise(0.0), F.when(F.col("benchmark_score").isNotNull(), 0.4).otherwise(0.0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.when(we + wb > 0, (we * z("evidence_score") + wb * z("benchmark_score")) / (we + wb))
    conf = F.when(we + wb > 0, F.least(F.lit(0.98), (we * z("evidence_confidence") + wb * z("benchmark_confidence")) / (we + wb))).otherwise(0.0)
    return j.withColumn("score", F.bround(F.round(score, 6), 0)).withColumn("confidence", conf).withColumn("status", F.when(F.col("score").isNull(), "insufficient").otherwise("scored"))


def weights_table(spark) -> DataFrame:
    return spark.createDataFrame(list(DIMENSION_WEIGHTS.items()), "dimension string, weight double")


def snapshot_rollup(scores: DataFrame, product: str) -> DataFrame:
    """Total, coverage and confidence over all seven dimensions; missing ones count as 0."""
    w = F.broadcast(weights_table(scores.sparkSession))
    s = scores.join(w, "dimension")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.groupBy(product).agg(F.sum(z("score") * F.col("weight")).alias("total"), F.sum(F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(0.0)).alias("coverage"), F.sum(F.when(F.col("score").isNotNull(), z("confidence") * F.col("weight")).otherwise(0.0)).alias("confidence"))


def version_scope(df: DataFrame, product: str, version: str) -> DataFrame:
    """The one version a product's rows speak of, else mixed or unknown."""
    g = df.groupBy(product).agg(F.min(version).alias("_lo"), F.max(version).alias("_hi"))
    return g.select(product, F.when(F.col("_lo").isNull(), "unknown").when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("mixed").alias("version_scope"))


def scope_dedup(df: DataFrame, key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row for each id, and the ids that come with unlike contents."""
    c = df.withColumn("_x", F.xxhash64(*content))
    bad = c.groupBy(key).agg(F.countDistinct("_x").alias("n_contents")).where("n_contents > 1")
    return df.dropDuplicates([key]), bad


def matrix_cells(now: DataFrame, before: DataFrame, product: str, baseline: str) -> DataFrame:
    """Products x dimensions with score (null unless scored), gap to the baseline product and change since before."""
    grid = now.select(product).distinct().crossJoin(F.broadcast(weights_table(now.sparkSession).select("dimension")))
    cell = grid.join(now.select(product, "dimension", "score"), [product, "dimension"], "left")
    base = now.where(F.col(product) == baseline).select("dimension", F.col("score").alias("_base"))
    prev = before.select(product, "dimension", F.col("score").alias("_prev"))
    cell = cell.join(F.broadcast(base), "dimension", "left").join(prev, [product, "dimension"], "left")
    return cell.select(product, "dimension", "score", (F.col("score") - F.col("_base")).alias("gap"), (F.col("score") - F.col("_prev")).alias("delta"))


def matrix_rows(cells: DataFrame) -> DataFrame:
    """Per dimension, and for all (null): valid products, mean, spread."""
    return cells.rollup("dimension").agg(F.count("score").alias("n_products"), F.round(F.avg("score"), 6).alias("mean"), (F.max("score") - F.min("score")).alias("spread"))


def product_summary(cells: DataFrame, confidence: DataFrame, product: str, least_cover: float = 0.80, least_trend: float = 0.80) -> DataFrame:
    """Coverage, total and confidence renormalised by coverage, weighted change over dimensions scored twice."""
    w = F.broadcast(weights_table(cells.sparkSession))
    c = cells.join(w, "dimension").join(confidence, [product, "dimension"], "left")
    part = lambda c, v: F.sum(F.when(F.col(c).isNotNull(), F.col("weight") * v))
    g = c.groupBy(product).agg(F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))), F.lit(0.0)).alias("coverage"), part("score", F.col("score")).alias("_t"), part("score", F.coalesce("confidence", F.lit(0.0))).alias("_c"), F.coalesce(F.sum(F.when(F.col("delta").isNotNull(), F.col("weight"))), F.lit(0.0)).alias("trend_coverage"), part("delta", F.col("delta")).alias("_d"))
    eps = 1e-9
    return g.select(product, F.round("coverage", 6).alias("coverage"), F.round(F.col("_t") / F.col("coverage"), 4).alias("total"), F.round(F.coalesce(F.col("_c") / F.col("coverage"), F.lit(0.0)), 6).alias("confidence"), (F.col("coverage") >= least_cover - eps).alias("eligible"), F.round("trend_coverage", 6).alias("trend_coverage"), F.when(F.col("trend_coverage") >= least_trend - eps, F.round(F.col("_d") / F.col("trend_coverage"), 4)).alias("change"))


def product_rank(summary: DataFrame, product: str, baseline: str) -> DataFrame:
    """Competition rank of eligible products by total, and the gap to the baseline's total."""
    ok = summary.where("eligible").withColumn("product_rank", F.rank().over(Window.orderBy(F.col("total").desc())))
    base = summary.where((F.col(product) == baseline) & F.col("eligible")).select(F.col("total").alias("_b"))
    j = summary.join(ok.select(product, "product_rank"), product, "left").join(F.broadcast(base), F.lit(True), "left")
    return j.select(product, "total", "product_rank", F.when(F.col("eligible"), F.round(F.col("total") - F.col("_b"), 4)).alias("gap_total"))


def contest(cells: DataFrame, least: int = 2) -> DataFrame:
    """mean - population deviation for each dimension with enough products."""
    g = cells.groupBy("dimension").agg(F.count("score").alias("n_products"), F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"), (F.max("score") - F.min("score")).alias("spread"))
    return g.where(F.col("n_products") >= least).select("dimension", "n_products", F.round(F.col("_m") - F.col("_s"), 6).alias("intensity"), "spread")


def gap_trends(now: DataFrame, before: DataFrame, product: str, baseline: str, tolerance: float = 1.0) -> DataFrame:
    """How the absolute gap to the baseline moved where all four scores are known."""
    gap = lambda d, name: d.where((F.col(product) != baseline) & F.col("score").isNotNull()).join(F.broadcast(d.where((F.col(product) == baseline) & F.col("score").isNotNull()).select("dimension", F.col("score").alias("_b"))), "dimension").select(product, "dimension", F.abs(F.col("score") - F.col("_b")).alias(name))
    j = gap(now, "gap_now").join(gap(before, "gap_before"), [product, "dimension"])
    move = F.col("gap_now") - F.col("gap_before")
    return j.withColumn("trend", F.when(move > tolerance, "widening").when(move < -tolerance, "narrowing").otherwise("stable"))


def table_stakes(cells: DataFrame, least: int = 3, bar: float = 70.0) -> DataFrame:
    """Dimensions where at least three products are scored and three reach the bar."""
    g = cells.groupBy("dimension").agg(F.count("score").alias("n_scored"), F.count_if(F.col("score") >= bar).alias("n_high"))
    return g.withColumn("verdict", F.when(F.col("n_scored") < least, "insufficient").when(F.col("n_high") >= least, "table_stakes").otherwise("not"))


def compare_runs(runs: DataFrame, product: str, tasks: int | Column) -> DataFrame:
    """Measures of each product's runs.  runs: task_id, task_type, success, compiled, pass_rate, edits, latency, cost, harmful."""
    b = lambda c: F.avg(F.col(c).cast("double"))
    return runs.groupBy(product).agg(
        F.count("*").alias("n_runs"), F.countDistinct("task_id").alias("n_tasks"), F.countDistinct("task_type").alias("n_types"),
        F.count_if("success").alias("n_success"), b("success").alias("success_rate"), b("compiled").alias("compile_rate"), F.count("compiled").alias("n_compiled"),
        F.avg("pass_rate").alias("pass_rate"), F.avg("edits").alias("mean_edits"), F.sum("edits").alias("total_edits"),
        F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"),
        F.count_if("harmful").alias("n_harmful"), (1 - b("harmful")).alias("safe_rate"),
        F.concat_ws(",", F.array_sort(F.collect_set("task_type"))).alias("types"),
    )


CONTRACT = ("task_revision", "task_fingerprint", "validator_sha256", "protocol_sha256", "starter_sha256")
PROTOCOL = ("task_revision", "task_fingerprint", "validator_sha256", "protocol_sha256")


def fingerprint(columns: list[str]) -> Column:
    """Digest of a task's definition: its columns by name as JSON without blanks, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def validate_runs(runs: DataFrame, tasks: DataFrame, task: str = "task_id", contract: tuple[str, ...] = CONTRACT, protocol: tuple[str, ...] = PROTOCOL, definition: list[str] | None = None) -> DataFrame:
    """Adds `reject` (null if fine) and `mismatches`: unknown tasks, runs that differ from the task's contract, tasks whose runs follow several protocols.

    The contract's columns are compared null-safely, as far as both tables have them; with
    `definition` the task's fingerprint is computed from those columns and not taken from
    the catalogue.  A protocol is mixed if runs of one task that are fine by themselves
    differ in `protocol` columns; all of them are rejected then.  A task listed twice is an error.
    """
    if definition is not None:
        tasks = tasks.withColumn("task_fingerprint", fingerprint(definition))
    own = [c for c in contract if c in runs.columns and c in tasks.columns]
    # a task listed twice would double its runs
    t = tasks.groupBy(F.col(task).alias("_t")).agg(F.count("*").alias("_k"), *[F.first(c).alias(f"_t_{c}") for c in own])
    t = t.withColumn("_k", F.when(F.col("_k") > 1, F.raise_error(F.concat(F.lit("task listed twice: "), F.col("_t").cast("string"))).cast("long")).otherwise(F.col("_k")))
    j = runs.join(t, F.col(task) == F.col("_t"), "left")
    off = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_t_{c}")), F.lit(c)) for c in own])) if own else F.array().cast("array<string>")
    j = j.withColumn("mismatches", F.when(F.col("_k").isNotNull(), off)).withColumn("_fine", F.col("_k").isNotNull() & (F.size("mismatches") == 0))
    said = [c for c in protocol if c in runs.columns]
    mixed = j.where("_fine").groupBy(F.col(task).alias("_m")).agg(F.count_distinct(F.struct(*said)).alias("_p")).where("_p > 1").select("_m") if said else None
    why = F.when(F.col("_k").isNull(), "unknown_task").when(F.size("mismatches") > 0, "contract_mismatch")
    if mixed is not None:
        j = j.join(mixed, F.col(task) == F.col("_m"), "left")
        why = why.when(F.col("_m").isNotNull(), "mixed_protocol")
    return j.withColumn("reject", why).select(*runs.columns, "mismatches", "reject")


def import_runs(existing: DataFrame, batch: DataFrame, key: str, content: list[str], seq: str) -> DataFrame:
    """Adds `action` to the batch: insert, batch_duplicate, replayed or conflict."""
    b = batch.withColumn("_x", F.xxhash64(*content)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq)))
    e = existing.select(F.col(key).alias("_k"), F.xxhash64(*content).alias("_e"))
    j = b.join(e, F.col(key) == F.col("_k"), "left")
    act = F.when(F.col("_n") > 1, "batch_duplicate").when(F.col("_k").isNull(), "insert").when(F.col("_x") == F.col("_e"), "replayed").otherwise("conflict")
    return j.withColumn("action", act).drop("_x", "_n", "_k", "_e")


def _of_cards(cards: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cards with `_n`, how many distinct chunks support each."""
    n = evidence.groupBy(F.col("card_id").alias("_c")).agg(F.countDistinct("chunk_id").alias("_n"))
    return cards.join(n, F.col("card_id") == F.col("_c"), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).drop("_c")


WEAK, CAP, PRIORITY_CAP = 0.55, 0.3, 39  # fixed values: confidence below which a card is reviewed; caps without evidence


def card_violations(cards: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """card_id, violation: distinct rows, of the cards given.

    cards: card_id, competitor, event_type, confidence, priority, has_conflicts,
    review_required.  evidence: card_id, chunk_id, competitor, event_type.  citations:
    card_id, kind (finding or impact), chunk_ids.  foreign_product, foreign_event (null is
    none): evidence of another one; unknown_chunk_<kind>: a citation outside the card's
    evidence; uncited_<kind>: no citation though there is evidence; review_missing: no
    evidence, conflicts or low confidence without review; cap_exceeded: no evidence, but
    more than the caps.
    """
    c = F.col
    plain = lambda x: F.lower(F.trim(c(x)))
    of = cards.select("card_id", plain("competitor").alias("_p"), c("event_type").alias("_e"))
    e = evidence.join(of, "card_id").select("card_id", F.explode(F.array_compact(F.array(F.when(~plain("competitor").eqNullSafe(c("_p")), "foreign_product"), F.when(c("event_type").isNotNull() & ~c("event_type").eqNullSafe(c("_e")), "foreign_event")))).alias("violation"))
    cited = citations.select("card_id", "kind", F.explode("chunk_ids").alias("chunk_id")).distinct()
    unknown = cited.join(evidence.select("card_id", "chunk_id"), ["card_id", "chunk_id"], "left_anti").select("card_id", F.concat(F.lit("unknown_chunk_"), "kind").alias("violation"))
    bare = citations.where(F.coalesce(F.size("chunk_ids"), F.lit(0)) <= 0).join(evidence.select("card_id"), "card_id", "left_semi").select("card_id", F.concat(F.lit("uncited_"), "kind").alias("violation"))
    none = c("_n") == 0
    own = F.array(
        F.when((none | c("has_conflicts") | (c("confidence") < WEAK)) & ~c("review_required"), "review_missing"),
        F.when(none & ((c("confidence") > CAP) | (c("priority") > PRIORITY_CAP)), "cap_exceeded"),
    )
    own = _of_cards(cards, evidence).select("card_id", F.explode(F.array_compact(own)).alias("violation"))
    return e.unionByName(unknown).unionByName(bare).distinct().join(cards.select("card_id"), "card_id", "left_semi").unionByName(own)


def cap_cards(cards: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cards with review_required, confidence and priority as the rules of card_violations have them."""
    c, none = F.col, F.col("_n") == 0
    review = c("review_required") | none | c("has_conflicts") | (c("confidence") < WEAK)
    return _of_cards(cards, evidence).withColumns({"review_required": review, "confidence": F.when(none, F.least("confidence", F.lit(CAP))).otherwise(c("confidence")), "priority": F.when(none, F.least("priority", F.lit(PRIORITY_CAP))).otherwise(c("priority"))}).drop("_n")


def cohort_violations(current: DataFrame, baseline: str, previous: DataFrame | None = None) -> DataFrame:
    """cohort, violation, subject, n.  Snapshots: cohort, product (case and outer blanks make no difference), version, window_days, snapshot_date.

    many_snapshots (n of a product), no_baseline (n of the cohort), mixed_version and
    mixed_window (n unlike ones); of previous ones: many_previous, previous_unknown (the
    product has no current one), previous_version (unlike every current one of the
    cohort), previous_later (than the product's latest).
    """
    c = F.col
    tidy = lambda d: d.withColumn("product", F.lower(F.trim("product")))
    out = lambda d, code, subject, n: d.select("cohort", F.lit(code).alias("violation"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))
    cur = tidy(current)
    per = cur.groupBy("cohort", "product").agg(F.count("*").alias("_n"), F.max("snapshot_date").alias("_last"))
    all_ = cur.groupBy("cohort").agg(F.count("*").alias("_n"), F.count_if(c("product") == baseline.strip().lower()).alias("_b"), F.countDistinct("version").alias("_v"), F.countDistinct("window_days").alias("_w"), F.collect_set("version").alias("_versions"))
    found = out(per.where("_n > 1"), "many_snapshots", c("product"), c("_n"))
    for code, when, subject, n in (("no_baseline", "_b = 0", F.lit(baseline), c("_n")), ("mixed_version", "_v > 1", F.lit("version"), c("_v")), ("mixed_window", "_w > 1", F.lit("window_days"), c("_w"))):
        found = found.unionByName(out(all_.where(when), code, subject, n))
    if previous is None:
        return found
    prev = tidy(previous)
    found = found.unionByName(out(prev.groupBy("cohort", "product").agg(F.count("*").alias("_n")).where("_n > 1"), "many_previous", c("product"), c("_n")))
    j = prev.join(per.drop("_n"), ["cohort", "product"], "left").join(all_.select("cohort", "_versions"), "cohort", "left")
    codes = F.array(F.when(c("_last").isNull(), "previous_unknown").when(c("snapshot_date") > c("_last"), "previous_later"), F.when(c("_versions").isNotNull() & ~F.array_contains("_versions", c("version")), "previous_version"))
    j = j.select("cohort", "product", F.explode(F.array_compact(codes)).alias("violation")).groupBy("cohort", "violation", "product").agg(F.count("*").alias("n"))
    return found.unionByName(j.select("cohort", "violation", c("product").alias("subject"), "n"))
