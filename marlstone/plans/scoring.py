"""Queries of cards, scores, comparison and run tables over orders and line items."""

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..registry import query

AS_OF = "2000-12-31"
_LV = "CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END"
_LW = "CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.62 ELSE 0.36 END"
_FR = "CASE WHEN age <= 30 THEN 1.0 WHEN age <= 90 THEN 0.85 WHEN age <= 180 THEN 0.65 ELSE 0.45 END"
_WT = "CASE dimension WHEN 'D1' THEN 0.20 WHEN 'D2' THEN 0.18 WHEN 'D3' THEN 0.12 WHEN 'D4' THEN 0.10 WHEN 'D5' THEN 0.10 WHEN 'D6' THEN 0.12 ELSE 0.18 END::DOUBLE"


def lines(table):
    """Line items as evidence of their order's card."""
    n = F.col("l_linenumber") % 4
    level = F.when(n == 0, "A").when(n == 1, "B").when(n == 2, "C").otherwise("D")
    return table("lineitem").withColumn("level", level).withColumn("dimension", F.concat(F.lit("D"), (1 + F.col("l_partkey") % 7).cast("string"))).withColumn("published", F.to_date("l_shipdate"))


_EV = f"""WITH ev AS (SELECT *, 'D' || (1 + l_partkey % 7) AS dimension, {_LV} AS level, {_LW}::DOUBLE AS lw, greatest(date_diff('day', l_shipdate::DATE, DATE '{AS_OF}'), 0) AS age FROM lineitem) """


@query("""WITH e AS (SELECT o_custkey AS request, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
 g AS (SELECT request, st, pr, min(rank) AS best_rank, count(*) AS n_chunks FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY best_rank, st, pr) AS cluster_no, greatest(count(*) OVER (PARTITION BY request) - 3, 0) AS n_dropped FROM g)
 SELECT * FROM n WHERE cluster_no <= 3""")
def k1_cluster_events(spark, table):
    from pyspark.sql import Window

    o = table("orders").select(F.col("o_custkey").alias("request"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rank"))
    return S.cluster_events(o, "request", ["st", "pr"], 3)


@query(_EV + ", g AS (SELECT l_orderkey, avg(lw) AS w, count(DISTINCT l_partkey) AS n FROM ev GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS n_chunks, round(CASE WHEN w IS NULL THEN 0.12 ELSE least(0.95, 0.24 + 0.55 * w + 0.045 * least(n, 5)) END, 6) AS confidence FROM orders LEFT JOIN g ON o_orderkey = l_orderkey")
def k2_card_confidence(spark, table):
    e = lines(table).withColumnRenamed("l_orderkey", "o_orderkey")
    return S.card_confidence(e, table("orders"), "o_orderkey", "level", "l_partkey").select("o_orderkey", "n_chunks", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE greatest(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}'), 0) END AS days, (o_orderkey % 10) / 10.0 AS conf, o_custkey % 4 AS ov FROM orders),
 u AS (SELECT *, CASE WHEN days IS NULL THEN 0.5 WHEN days <= 30 THEN 0.95 WHEN days <= 120 THEN 0.72 ELSE 0.45 END AS urgency, least(1.0, 0.35 + 0.65 * ov / 3) AS relevance FROM o),
 p AS (SELECT *, greatest(0, least(100, round_even(round(35 * 0.68 + 25 * urgency + 20 * conf + 20 * relevance, 6), 0)::INT)) AS priority FROM u)
 SELECT o_orderkey, priority, CASE WHEN priority >= 80 THEN 'red' WHEN priority >= 60 THEN 'orange' WHEN priority >= 40 THEN 'yellow' ELSE 'blue' END AS alert FROM p""")
def k3_card_priority(spark, table):
    o = table("orders")
    latest = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    return S.card_priority(o, latest, F.lit(AS_OF).cast("date"), (F.col("o_orderkey") % 10) / 10.0, F.col("o_custkey") % 4, 3).select("o_orderkey", "priority", "alert")


@query(_EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM ev), f AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS findings, count(*) AS n_evidence, count(DISTINCT dimension) AS n_impacts,
   round(least(0.95, 0.24 + 0.55 * avg(lw) + 0.045 * least(count(DISTINCT l_partkey), 5)), 6) AS c FROM r GROUP BY 1)
 SELECT o_orderkey, coalesce(findings, '') AS findings, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_impacts, 0) AS n_impacts, greatest(1, least(10, round_even(round(0.68 * coalesce(c, 0.12) * 10, 6), 0)::INT)) AS magnitude FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def k4_build_cards(spark, table):
    e = lines(table).withColumnRenamed("l_orderkey", "o_orderkey")
    conf = S.card_confidence(e, table("orders"), "o_orderkey", "level", "l_partkey").withColumn("confidence", F.round("confidence", 6))
    items = F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), 1, 3)
    g = e.groupBy("o_orderkey").agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ",").alias("findings"), F.count("*").alias("n_evidence"), F.countDistinct("dimension").alias("n_impacts"))
    z = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return conf.join(g, "o_orderkey", "left").select("o_orderkey", z("findings", ""), z("n_evidence", 0), z("n_impacts", 0), S.magnitude(0.68, F.col("confidence")).alias("magnitude"))


@query("""WITH ev AS (SELECT l_orderkey AS card_id, l_partkey AS chunk_id, l_linestatus AS comp FROM lineitem WHERE l_quantity > 5), cd AS (SELECT o_orderkey AS card_id, o_orderstatus AS comp, least(1.0, o_totalprice / 400000) AS conf, o_orderpriority = '1-URGENT' AS rev FROM orders),
 ci AS (SELECT l_orderkey AS card_id, 'finding' AS kind, [l_partkey] AS ids FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT o_orderkey, 'impact', coalesce(list(l_partkey) FILTER (l_returnflag = 'R'), []) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
 n AS (SELECT card_id, count(*) AS n FROM ev GROUP BY 1),
 v AS (SELECT DISTINCT card_id, 'foreign_product' AS violation FROM ev JOIN cd USING (card_id) WHERE ev.comp <> cd.comp UNION ALL SELECT DISTINCT card_id, 'unknown_chunk_' || kind FROM (SELECT card_id, kind, unnest(ids) AS chunk_id FROM ci) x ANTI JOIN ev USING (card_id, chunk_id)
  UNION ALL SELECT DISTINCT card_id, 'uncited_' || kind FROM ci JOIN n USING (card_id) WHERE len(ids) = 0 UNION ALL SELECT card_id, 'review_missing' FROM cd LEFT JOIN n USING (card_id) WHERE (n IS NULL OR conf < 0.55) AND NOT rev UNION ALL SELECT card_id, 'cap_exceeded' FROM cd LEFT JOIN n USING (card_id) WHERE n IS NULL AND conf > 0.3)
 SELECT card_id, violation FROM v WHERE card_id IN (SELECT card_id FROM cd)""")
def k5_card_violations(spark, table):
    """Orders as cards of their status, larger line items as evidence of theirs."""
    c, li, none = F.col, table("lineitem"), F.lit(None).cast("string")
    ev = li.where("l_quantity > 5").select(c("l_orderkey").alias("card_id"), c("l_partkey").alias("chunk_id"), c("l_linestatus").alias("competitor"), none.alias("event_type"))
    share = F.least(F.lit(1.0), c("o_totalprice") / 400000)
    cards = table("orders").select(c("o_orderkey").alias("card_id"), c("o_orderstatus").alias("competitor"), none.alias("event_type"), share.alias("confidence"), F.lit(0).alias("priority"), F.lit(False).alias("has_conflicts"), (c("o_orderpriority") == "1-URGENT").alias("review_required"))
    impact = cards.select("card_id").join(li.where("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("card_id")).agg(F.collect_list("l_partkey").alias("chunk_ids")), "card_id", "left").withColumn("kind", F.lit("impact"))
    ci = li.where("l_linenumber <= 2").select(c("l_orderkey").alias("card_id"), F.lit("finding").alias("kind"), F.array("l_partkey").alias("chunk_ids")).unionByName(impact)
    return S.card_violations(cards, ev, ci)


@query(_EV + f"SELECT {_FR}::DOUBLE AS weight, count(*) AS n FROM ev GROUP BY 1")
def k6_freshness_weight(spark, table):
    return lines(table).groupBy(S.freshness_weight(F.col("published"), F.lit(AS_OF).cast("date")).alias("weight")).agg(F.count("*").alias("n"))


def contributions(table):
    e = lines(table).withColumn("weight", F.round(S.level_weight(F.col("level")) * S.freshness_weight(F.col("published"), F.lit(AS_OF).cast("date")), 6)).withColumn("size", F.col("l_quantity") % 10 + 1)
    return S.evidence_contributions(e, ["l_suppkey", "dimension", "l_partkey"], "weight", "size", "l_orderkey")


_CO = _EV + f""", wv AS (SELECT *, round(lw * {_FR}, 6)::DOUBLE AS weight, l_quantity % 10 + 1 AS size FROM ev), co AS (SELECT * FROM wv QUALIFY row_number() OVER (PARTITION BY l_suppkey, dimension, l_partkey ORDER BY weight DESC, size DESC, l_orderkey DESC) = 1) """


@query(_CO + "SELECT l_suppkey, dimension, l_partkey, weight, size, l_orderkey FROM co")
def k7_evidence_contributions(spark, table):
    return contributions(table).select("l_suppkey", "dimension", "l_partkey", "weight", "size", "l_orderkey")


_ES = """, es AS (SELECT l_suppkey, dimension, count(*) AS n_evidence, count(DISTINCT l_returnflag) AS n_sources, greatest(0.0, least(100.0, 50 + 4 * sum(weight * CASE WHEN l_returnflag = 'R' THEN -size ELSE size END) / sum(weight))) AS evidence_score,
  least(0.96, avg(weight) * least(1.0, 0.45 + 0.12 * count(*)) * least(1.0, 0.75 + 0.08 * count(DISTINCT l_returnflag))) AS evidence_confidence FROM co GROUP BY ALL) """


def escores(table):
    c = contributions(table).withColumn("signed", F.when(F.col("l_returnflag") == "R", -F.col("size")).otherwise(F.col("size")))
    return S.evidence_score(c, ["l_suppkey", "dimension"], "weight", "signed", "l_returnflag")


@query(_CO + _ES + "SELECT l_suppkey, dimension, n_evidence, n_sources, round(evidence_score + 1e-9, 6) AS evidence_score, round(evidence_confidence + 1e-9, 6) AS evidence_confidence FROM es")
def k8_evidence_score(spark, table):
    return escores(table).select("l_suppkey", "dimension", "n_evidence", "n_sources", F.round(F.col("evidence_score") + 1e-9, 6).alias("evidence_score"), F.round(F.col("evidence_confidence") + 1e-9, 6).alias("evidence_confidence"))


def runs(table):
    c = F.col
    d = table("lineitem").join(table("part").select(c("p_partkey").alias("l_partkey"), c("p_type").alias("task_type")), "l_partkey")
    score = S.run_score((c("l_returnflag") != "R").cast("double"), c("l_discount"), F.when(c("l_linenumber") != 3, (c("l_linestatus") == "O").cast("double")), c("l_linenumber"), c("l_quantity") > 45)
    return d.withColumn("run_score", F.round(score, 2)).withColumn("task_id", c("l_partkey"))


_RU = """WITH ru AS (SELECT l.*, p_type AS task_type, greatest(0.0, least(100.0, 100 * CASE WHEN l_linenumber = 3 THEN (0.55 * CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END + 0.30 * l_discount) / 0.85
   ELSE 0.55 * CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END + 0.30 * l_discount + 0.15 * CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END END - least(16.0, 2.0 * l_linenumber) - CASE WHEN l_quantity > 45 THEN 30.0 ELSE 0.0 END)) AS raw FROM lineitem l JOIN part ON p_partkey = l_partkey),
 rs AS (SELECT *, round(raw, 2)::DOUBLE AS run_score FROM ru) """


@query(_RU + "SELECT l_orderkey, l_linenumber, run_score FROM rs")
def k9_run_score(spark, table):
    return runs(table).select("l_orderkey", "l_linenumber", "run_score")


_BS = """, td AS (SELECT p_partkey, 'D' || (1 + p_size % 7) AS dimension FROM part), tn AS (SELECT dimension, count(*) AS nt FROM td GROUP BY 1),
 bs AS (SELECT l_suppkey, dimension, avg(run_score) AS benchmark_score, count(*) AS n_runs, least(0.98, count(DISTINCT l_partkey)::DOUBLE / any_value(nt) * least(1.0, 0.65 + 0.08 * count(*))) AS benchmark_confidence FROM rs JOIN td ON l_partkey = p_partkey JOIN tn USING (dimension) GROUP BY ALL) """


def bscores(table):
    tasks = table("part").select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("D"), (1 + F.col("p_size") % 7).cast("string")).alias("dimension"))
    return S.benchmark_score(runs(table), tasks, "l_suppkey", "task_id", "dimension", "run_score")


@query(_RU + _BS + "SELECT l_suppkey, dimension, round(benchmark_score, 8) AS benchmark_score, n_runs, round(benchmark_confidence, 6) AS benchmark_confidence FROM bs")
def k10_benchmark_dimension_score(spark, table):
    return bscores(table).select("l_suppkey", "dimension", F.round("benchmark_score", 8).alias("benchmark_score"), "n_runs", F.round("benchmark_confidence", 6).alias("benchmark_confidence"))


_DS = _RU + _BS + ", " + _EV[5:] + _CO[len(_EV):] + _ES + """, ds AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.dimension, b.dimension) AS dimension, evidence_score AS e, benchmark_score AS b, evidence_confidence AS ec, benchmark_confidence AS bc FROM (SELECT * FROM es WHERE (l_suppkey + substr(dimension, 2)::INT) % 5 <> 0) a FULL OUTER JOIN (SELECT * FROM bs WHERE (l_suppkey + substr(dimension, 2)::INT) % 4 <> 0) b ON a.l_suppkey = b.l_suppkey AND a.dimension = b.dimension),
 sc AS (SELECT l_suppkey, dimension, round_even(round((CASE WHEN e IS NULL THEN 0 ELSE 0.6 * e END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 * b END) / (CASE WHEN e IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END), 6), 0)::DOUBLE AS score,
   round(least(0.98, (CASE WHEN e IS NULL THEN 0 ELSE 0.6 * ec END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 * bc END) / (CASE WHEN e IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END)), 6)::DOUBLE AS confidence FROM ds) """


def scores(table):
    keep = lambda d, m: d.where((F.col("l_suppkey") + F.substring("dimension", 2, 1).cast("int")) % m != 0)
    return S.dimension_score(keep(escores(table), 5), keep(bscores(table), 4), ["l_suppkey", "dimension"]).select("l_suppkey", "dimension", "score", F.round("confidence", 6).alias("confidence"), "status")


@query(_DS + "SELECT *, 'scored' AS status FROM sc")
def k11_dimension_score(spark, table):
    return scores(table)


@query(_DS + f"SELECT l_suppkey, round(sum(score * {_WT}), 6) AS total, round(sum({_WT}), 6) AS coverage, round(sum(confidence * {_WT}), 6) AS confidence FROM sc GROUP BY 1")
def k12_snapshot_rollup(spark, table):
    return S.snapshot_rollup(scores(table), "l_suppkey").select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("total", "coverage", "confidence")])


@query("SELECT o_custkey, CASE WHEN max(v) IS NULL THEN 'unknown' WHEN min(v) = max(v) THEN min(v) ELSE 'mixed' END AS version_scope FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS v FROM orders) GROUP BY 1")
def k13_version_scope(spark, table):
    return S.version_scope(table("orders").withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))), "o_custkey", "v")


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n_contents FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def k14_scope_dedup(spark, table):
    return S.scope_dedup(table("lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])[1]


# comparison: market segments as products, dimensions from customer keys, two periods

_CELL = f"""WITH s AS (SELECT c_mktsegment AS product, 'D' || (1 + o_custkey % 7) AS dimension, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
 md AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.5) AS m FROM orders),
 now AS (SELECT product, dimension, round(avg(o_totalprice) % 100, 3) AS score FROM s, md WHERE epoch_us(o_orderdate) > m AND NOT (product = 'BUILDING' AND dimension = 'D3') GROUP BY ALL),
 bef AS (SELECT product, dimension, round(avg(o_totalprice) % 100, 3) AS score FROM s, md WHERE epoch_us(o_orderdate) <= m AND NOT (product = 'MACHINERY' AND dimension IN ('D1', 'D2')) GROUP BY ALL),
 gr AS (SELECT product, 'D' || d AS dimension FROM (SELECT DISTINCT product FROM now), (SELECT unnest(range(1, 8)) AS d)),
 ce AS (SELECT gr.product, gr.dimension, n.score, round(n.score - b.score, 3) AS gap, round(n.score - p.score, 3) AS delta FROM gr LEFT JOIN now n USING (product, dimension) LEFT JOIN now b ON b.product = 'AUTOMOBILE' AND b.dimension = gr.dimension LEFT JOIN bef p ON p.product = gr.product AND p.dimension = gr.dimension) """


def periods(table):
    o = table("orders").join(table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("product")), "o_custkey")
    o = o.withColumn("dimension", F.concat(F.lit("D"), (1 + F.col("o_custkey") % 7).cast("string"))).withColumn("us", F.unix_micros("o_orderdate"))
    m = F.broadcast(table("orders").agg(F.expr("percentile(unix_micros(o_orderdate), 0.5)").alias("m")))
    o = o.crossJoin(m)
    score = F.round(F.avg("o_totalprice") % 100, 3).alias("score")
    now = o.where((F.col("us") > F.col("m")) & ~((F.col("product") == "BUILDING") & (F.col("dimension") == "D3"))).groupBy("product", "dimension").agg(score)
    bef = o.where((F.col("us") <= F.col("m")) & ~((F.col("product") == "MACHINERY") & F.col("dimension").isin("D1", "D2"))).groupBy("product", "dimension").agg(score)
    return now, bef


def cells(table):
    c = S.matrix_cells(*periods(table), "product", "AUTOMOBILE")
    return c.select("product", "dimension", "score", F.round("gap", 3).alias("gap"), F.round("delta", 3).alias("delta"))


def summary(table):
    c = cells(table)
    return S.product_summary(c, c.select("product", "dimension", F.lit(0.5).alias("confidence")), "product")


_SUM = f""", su AS (SELECT product, round(coalesce(sum({_WT}) FILTER (score IS NOT NULL), 0), 6) AS coverage, round(sum(score * {_WT}) / sum({_WT}) FILTER (score IS NOT NULL), 4) AS total, round(sum({_WT}) FILTER (score IS NOT NULL), 6) >= 0.8 AS eligible,
 round(coalesce(sum({_WT}) FILTER (delta IS NOT NULL), 0), 6) AS trend_coverage, CASE WHEN round(sum({_WT}) FILTER (delta IS NOT NULL), 6) >= 0.8 THEN round(sum(delta * {_WT}) / sum({_WT}) FILTER (delta IS NOT NULL), 4) END AS change FROM ce GROUP BY product) """


@query(_CELL + "SELECT * FROM ce")
def x1_matrix_cells(spark, table):
    return cells(table)


@query(_CELL + "SELECT dimension, count(score) AS n_products, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS spread FROM ce GROUP BY ROLLUP (dimension)")
def x2_matrix_rows(spark, table):
    return S.matrix_rows(cells(table)).withColumn("spread", F.round("spread", 6))


@query(_CELL + _SUM + "SELECT product, coverage, total, 0.5::DOUBLE AS confidence, eligible, trend_coverage, change FROM su")
def x3_product_summary(spark, table):
    return summary(table)


@query(_CELL + _SUM + """SELECT su.product, su.total, r.product_rank, CASE WHEN su.eligible THEN round(su.total - b.total, 4) END AS gap_total FROM su LEFT JOIN (SELECT product, rank() OVER (ORDER BY total DESC) AS product_rank FROM su WHERE eligible) r USING (product) LEFT JOIN (SELECT total FROM su WHERE product = 'AUTOMOBILE' AND eligible) b ON true""")
def x4_product_rank(spark, table):
    return S.product_rank(summary(table), "product", "AUTOMOBILE")


@query(_CELL + _SUM + "SELECT product, change, trend_coverage FROM su WHERE change > 0 ORDER BY change DESC, product LIMIT 1")
def x5_growth(spark, table):
    return summary(table).where("change > 0").orderBy(F.col("change").desc(), "product").limit(1).select("product", "change", "trend_coverage")


@query(_CELL + "SELECT dimension, count(score) AS n_products, round(avg(score) - stddev_pop(score), 6) AS intensity, round(max(score) - min(score), 6) AS spread FROM ce GROUP BY 1 HAVING count(score) >= 2")
def x6_contest_intensity(spark, table):
    return S.contest(cells(table)).withColumn("spread", F.round("spread", 6))


@query(_CELL + """, g AS (SELECT n.product, n.dimension, round(abs(n.score - nb.score), 3) AS gap_now, round(abs(p.score - pb.score), 3) AS gap_before FROM now n JOIN now nb ON nb.product = 'AUTOMOBILE' AND nb.dimension = n.dimension JOIN bef p ON p.product = n.product AND p.dimension = n.dimension JOIN bef pb ON pb.product = 'AUTOMOBILE' AND pb.dimension = n.dimension WHERE n.product <> 'AUTOMOBILE')
 SELECT *, CASE WHEN gap_now - gap_before > 1 THEN 'widening' WHEN gap_now - gap_before < -1 THEN 'narrowing' ELSE 'stable' END AS trend FROM g""")
def x7_gap_trends(spark, table):
    g = S.gap_trends(*periods(table), "product", "AUTOMOBILE")
    return g.select("product", "dimension", F.round("gap_now", 3).alias("gap_now"), F.round("gap_before", 3).alias("gap_before"), "trend")


@query(_CELL + "SELECT dimension, count(score) AS n_scored, count(*) FILTER (score >= 60) AS n_high, CASE WHEN count(score) < 3 THEN 'insufficient' WHEN count(*) FILTER (score >= 60) >= 3 THEN 'table_stakes' ELSE 'not' END AS verdict FROM ce GROUP BY 1")
def x8_table_stakes(spark, table):
    return S.table_stakes(cells(table), bar=60.0)


@query("""WITH c AS (SELECT c_nationkey AS cohort, lower(c_mktsegment) AS product, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS version FROM customer)
 SELECT cohort, 'many_snapshots' AS violation, product AS subject, count(*) AS n FROM c GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT cohort, 'no_baseline', 'AUTOMOBILE', count(*) FROM c GROUP BY cohort HAVING count(*) FILTER (product = 'automobile') = 0
 UNION ALL SELECT cohort, 'mixed_version', 'version', count(DISTINCT version) FROM c GROUP BY cohort HAVING count(DISTINCT version) > 1""")
def x9_cohort_violations(spark, table):
    c = table("customer").select(F.col("c_nationkey").alias("cohort"), F.col("c_mktsegment").alias("product"), F.when(F.col("c_acctbal") < 0, 1).otherwise(2).alias("version"), F.lit(90).alias("window_days"), F.lit("2024-01-20").cast("date").alias("snapshot_date"))
    return S.cohort_violations(c, "AUTOMOBILE")


@query("""SELECT n_nationkey, coalesce(k, 0) AS n_baseline, k IS NULL AS is_default FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY 1) ON n_nationkey = c_nationkey""")
def x10_default_baseline(spark, table):
    have = table("customer").where("c_mktsegment = 'AUTOMOBILE'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_baseline")).withColumn("is_default", F.lit(False))
    none = table("nation").select("n_nationkey").join(have, "n_nationkey", "left_anti").withColumns({"n_baseline": F.lit(0).cast("long"), "is_default": F.lit(True)})
    return have.unionByName(none)


@query("""WITH t AS (SELECT p_partkey, p_size % 3 AS rev, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_type":"' || p_type || '"}') AS fp FROM part),
 r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS rev, x.fp, l_returnflag AS validator FROM lineitem LEFT JOIN t x ON x.p_partkey = l_partkey - CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END),
 j AS (SELECT r.*, t.p_partkey IS NULL AS unknown, concat_ws(',', CASE WHEN r.fp IS DISTINCT FROM t.fp THEN 'task_fingerprint' END, CASE WHEN r.rev IS DISTINCT FROM t.rev THEN 'task_revision' END) AS m FROM r LEFT JOIN t ON t.p_partkey = r.l_partkey),
 x AS (SELECT l_partkey FROM j WHERE NOT unknown AND m = '' GROUP BY 1 HAVING count(DISTINCT validator) > 1)
 SELECT l_orderkey, l_linenumber, CASE WHEN NOT unknown THEN m END AS mismatches, CASE WHEN unknown THEN 'unknown_task' WHEN m <> '' THEN 'contract_mismatch' WHEN l_partkey IN (SELECT l_partkey FROM x) THEN 'mixed_protocol' END AS reject FROM j""")
def b1_validate_runs(spark, table):
    """Line items as runs of parts; a run with a large discount states the fingerprint of the part before."""
    c, p = F.col, table("part")
    seen = p.select(c("p_partkey").alias("_p"), S.fingerprint(["p_name", "p_brand", "p_type"]).alias("task_fingerprint"))
    of = c("l_partkey") - F.when(c("l_discount") >= 0.09, 1).otherwise(0)
    r = table("lineitem").withColumn("_of", of).join(seen, c("_of") == c("_p"), "left").select("l_orderkey", "l_linenumber", c("l_partkey").alias("task_id"), (c("l_suppkey") % 3).cast("int").alias("task_revision"), "task_fingerprint", c("l_returnflag").alias("validator_sha256"))
    t = p.select(c("p_partkey").alias("task_id"), (c("p_size") % 3).alias("task_revision"), "p_name", "p_brand", "p_type")
    v = S.validate_runs(r, t, definition=["p_name", "p_brand", "p_type"])
    return v.select("l_orderkey", "l_linenumber", F.array_join(F.array_sort("mismatches"), ",").alias("mismatches"), "reject")


@query("""WITH b AS (SELECT l_orderkey AS run_id, l_returnflag AS c, l_linenumber AS seq FROM lineitem WHERE l_orderkey % 3 <> 0), e AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'N' END AS c FROM orders WHERE o_orderkey % 4 <> 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, c) AS n FROM b)
 SELECT action, count(*) AS n FROM (SELECT CASE WHEN n > 1 THEN 'batch_duplicate' WHEN e.run_id IS NULL THEN 'insert' WHEN n.c = e.c THEN 'replayed' ELSE 'conflict' END AS action FROM n LEFT JOIN e USING (run_id)) GROUP BY 1""")
def b2_import_runs(spark, table):
    b = table("lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("c"), F.struct("l_linenumber", "l_returnflag").alias("seq"))
    e = table("orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("N").alias("c"))
    return S.import_runs(e, b, "run_id", ["c"], "seq").groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, count(*) AS n_runs, count(DISTINCT l_partkey) AS n_tasks, count(DISTINCT p_type) AS n_types, count(*) FILTER (l_returnflag <> 'R') AS n_success, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
 round(avg(CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS compile_rate, count(*) FILTER (l_linenumber <> 3) AS n_compiled, round(avg(l_discount), 6) AS pass_rate, sum(l_linenumber)::BIGINT AS total_edits, round(sum(l_extendedprice), 2) AS total_cost,
 count(*) FILTER (l_quantity > 45) AS n_harmful, round(1 - avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END), 6) AS safe_rate, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def b3_compare_runs(spark, table):
    c = F.col
    r = runs(table).select("l_suppkey", "task_id", "task_type", (c("l_returnflag") != "R").alias("success"), F.when(c("l_linenumber") != 3, c("l_linestatus") == "O").alias("compiled"), c("l_discount").alias("pass_rate"), c("l_linenumber").alias("edits"), c("l_tax").alias("latency"), c("l_extendedprice").alias("cost"), (c("l_quantity") > 45).alias("harmful"))
    g = S.compare_runs(r, "l_suppkey", 0)
    return g.select("l_suppkey", "n_runs", "n_tasks", "n_types", "n_success", *[F.round(x, 6).alias(x) for x in ("success_rate", "compile_rate")], "n_compiled", F.round("pass_rate", 6).alias("pass_rate"), "total_edits", F.round("total_cost", 2).alias("total_cost"), "n_harmful", F.round("safe_rate", 6).alias("safe_rate"), "types")


@query("""SELECT p_type, count(*) AS n_tasks, count(*) - count(DISTINCT p_name) AS n_repeated_names, count(*) BETWEEN 5 AND 200000 AS in_range, substr(sha256(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)), 1, 16) AS fingerprint FROM part GROUP BY 1""")
def b4_catalog_checks(spark, table):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table("part").groupBy("p_type").agg(F.count("*").alias("n_tasks"), (F.count("*") - F.countDistinct("p_name")).alias("n_repeated_names"), F.count("*").between(5, 200000).alias("in_range"), F.substring(F.sha2(ids, 256), 1, 16).alias("fingerprint"))
