"""The whole answer chain for many questions: filters, expansion, retrieval, ranking, evidence, conflicts, and a trace of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import written
from . import evidence, filters, retrieval, tables

TIMES = ("as_of", "start_time", "end_time")
STATES = {"is_current": "boolean", "published": "timestamp", "product_version": "string", "valid_from": "timestamp", "valid_to": "timestamp"}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in columns.items() if c not in df.columns})


def asked(questions: DataFrame, query_id: str, text: str, now: Column, aliases: DataFrame | None = None, kinds: dict[str, list[str]] | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """questions with `expanded`, and with any_competitor, current_only, versions, start_time and q_start from their text where they do not state these themselves."""
    q = _with(questions, {"any_competitor": "array<string>", "current_only": "boolean", "versions": "array<string>", **{t: "timestamp" for t in TIMES}})
    if aliases is not None:
        told = tables.infer_filters(q, query_id, text, aliases, kinds or {}).select(F.col(query_id).alias("_i"), F.col("competitor").alias("_c"), F.col("versions").alias("_v"), F.col("days").alias("_d"), F.col("current").alias("_n"))
        q = q.join(told, q[query_id] == F.col("_i"))
        empty = F.coalesce(F.size("any_competitor"), F.lit(0)) <= 0
        since = F.when(F.col("_d").isNotNull(), now - F.make_dt_interval(F.col("_d")))
        q = q.withColumns({
            "any_competitor": F.when(empty & F.col("_c").isNotNull(), F.array("_c")).otherwise(F.col("any_competitor")),
            "current_only": F.coalesce("current_only", "_n"),
            "versions": F.when(F.coalesce(F.size("versions"), F.lit(0)) <= 0, F.col("_v")).otherwise(F.col("versions")),
            "start_time": F.coalesce("start_time", since),
        }).drop("_i", "_c", "_v", "_d", "_n")
    if synonyms is not None:
        more = tables.expand_queries(q, query_id, text, synonyms).select(F.col(query_id).alias("_i"), "expanded")
        q = q.join(more, q[query_id] == F.col("_i")).drop("_i")
    else:
        q = q.withColumn("expanded", F.col(text))
    return q.withColumns({"q_start": F.col("start_time"), "q_end": F.col("end_time")})


def answer(
    questions: DataFrame, chunks: DataFrame, query_id: str, id_col: str, now: Column, text: str = "text", aliases: DataFrame | None = None, synonyms: DataFrame | None = None, kinds: dict[str, list[str]] | None = None,
    lists: dict[str, str] | None = None, window: tuple[int, int, int, int] = (20, 20, 30, 20), k: int = 5, dim: int = 384, weights: tuple[float, float] = (0.8, 0.2), temporal: bool = True, strict: bool = True,
) -> dict[str, DataFrame]:
    """results, evidence, conflicts and trace of every question.

    A question's filter comes from its own columns (those of `lists`, current_only,
    start_time, end_time) and, where it has none, from its text; what it asks for is
    expanded by synonyms.  BM25 and hashed vectors rank the filtered set alone (`window`:
    sizes of both lists, of the fused and of the reranked one; never fewer than k), then
    lexical reranking, time and version (if `temporal`), authority and blend.  The first k
    become evidence with quotes and citation ids, and facts that they state against each
    other become conflicts.  trace: question, stage, n, with 0 where a stage has nothing.

    Stages are written to the shared folder (registry.scratch).  chunks: id, text, level,
    fact, competitor where lists are not given, and what they
    have of STATES and of the columns that stated_facts reads.
    """
    lists = {"any_competitor": "competitor"} if lists is None else lists
    first, second, fused, kept = (max(x, k) for x in window)
    # what later stages and the trace read again is written once, so that plans stay small and a lost executor costs one stage
    q = written(asked(questions, query_id, text, now, aliases, kinds, synonyms), "questions")
    d = _with(chunks, STATES)
    by, sigs = filters.signatures(q, query_id, lists)
    member = filters.match(d.select(id_col, *dict.fromkeys([*lists.values(), "is_current", "published"])), sigs, lists).select("sig", id_col)
    a = retrieval.bm25_filtered(q.select(query_id, "expanded", *lists, "current_only", "q_start", "q_end"), d, query_id, "expanded", id_col, {text: 1}, first, lists)
    held = member.groupBy(id_col).agg(F.collect_set("sig").alias("_sigs"))  # a chunk's filters, as many as there are kinds of question
    v = retrieval.hash_vectors(d, id_col, text, dim).join(held, id_col)
    qv = retrieval.hash_vectors(q, query_id, text, dim).join(by, query_id)
    b = retrieval.dense_topk(qv, v, second, id_col=id_col, query_col=query_id, scope=("sig", "_sigs")).where("score > 0").withColumnsRenamed({"query_id": query_id, "id": id_col})
    a, b = written(a.select(query_id, id_col, "rank"), "bm25"), written(b.select(query_id, id_col, "rank"), "dense")
    f = retrieval.rrf_fuse([a, b], query_id, id_col).where(F.col("rank") <= fused).select(query_id, id_col, F.col("rrf_score").alias("score"))
    ranks = a.withColumnRenamed("rank", "bm25_rank").join(b.withColumnRenamed("rank", "dense_rank"), [query_id, id_col], "full")
    c = f.join(ranks, [query_id, id_col]).join(q.select(query_id, F.col(text).alias("question"), "current_only", "versions", *TIMES), query_id)
    c = c.join(d.select(id_col, F.col(text).alias("_text"), F.col("level").alias("_level"), F.col("fact").alias("_fact"), *[x for x in STATES if x != "published"], F.col("published").alias("publish_time")), id_col)
    r = retrieval.lexical_rerank(c, query_id, id_col, "question", "_text").where(F.col("rank") <= kept)
    r = written(r, "reranked")
    reranked, r = r.select(query_id, id_col), r.withColumn("rrf_score", F.col("score")).withColumn("score", F.col("final_score")).drop("final_score", "rank", "_text")
    if temporal:
        r = retrieval.temporal_rank(r, query_id, id_col, now, strict=strict).withColumnRenamed("final_score", "relevance").drop("rank")
    else:
        r = r.withColumns({"relevance": F.col("score"), "time_score": F.lit(None).cast("double"), "version_score": F.lit(None).cast("double")})
    r = retrieval.blend(retrieval.authority(r, query_id, "_level", "_fact"), query_id, id_col, {"relevance": weights[0], "evidence_score": weights[1]})
    r = written(r, "ranked")
    out = r.where(F.col("rank") <= k).select(query_id, id_col, "bm25_rank", "dense_rank", "rrf_score", "rerank_score", "time_score", "version_score", "evidence_score", "final_score", "rank")
    said = out.join(q.select(query_id, F.col(text).alias("question")), query_id).join(d.select(id_col, F.col(text).alias("_text")), id_col)
    quotes = evidence.select_quotes(said, query_id, id_col, "question", "_text")
    proof = evidence.build_evidence(out.join(quotes, [query_id, id_col], "left"), query_id, id_col, k)
    facts = evidence.stated_facts(d.join(out.select(id_col).distinct(), id_col, "left_semi"), id_col).join(out.select(query_id, id_col, "final_score"), id_col)
    facts = facts.join(d.select(F.col(id_col).alias("_d"), "valid_from", "valid_to", "is_current", F.col("level").alias("evidence_level"), F.col("published").alias("publish_time")), F.col(id_col) == F.col("_d")).drop("_d")
    clash = written(evidence.detect_conflicts(written(facts, "facts"), [query_id, "entity", "field"], id_col), "conflicts")
    proof = written(proof, "evidence")
    sets = by.join(member.groupBy("sig").agg(F.count("*").alias("n")), "sig").select(query_id, F.lit("filtered").alias("stage"), "n")
    count = lambda t, name: t.groupBy(query_id).agg(F.count("*").alias("n")).select(query_id, F.lit(name).alias("stage"), "n")
    stages = {"bm25": a, "dense": b, "fused": f, "reranked": reranked, "ranked": r, "final": out, "evidence": proof, "conflicts": clash}
    counts = reduce(DataFrame.unionByName, [sets, *[count(t, name) for name, t in stages.items()]])
    every = questions.select(query_id, F.explode(F.array(*[F.lit(x) for x in ("filtered", *stages)])).alias("stage"))
    trace = every.join(counts, [query_id, "stage"], "left").select(query_id, "stage", F.coalesce("n", F.lit(0)).alias("n"))
    return {"results": out, "evidence": proof, "conflicts": clash, "trace": trace}
