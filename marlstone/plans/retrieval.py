"""Queries of the index tables, ranking, evidence and evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, evidence, prepare, retrieval
from ..registry import query, written

_W = "regexp_extract_all(lower({c}), '[a-z0-9]+(?:[._+#/-][a-z0-9]+)*')"
_BASE = f"""WITH dt AS (SELECT doc_id, unnest({_W.format(c="text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
 dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS avg_len),
 qt AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_W.format(c="text")}) AS term FROM benchmark) GROUP BY ALL),
 dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT item_id, doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score, count(*) AS common FROM qt JOIN tf USING (term) JOIN dfr USING (term) JOIN dl USING (doc_id), st GROUP BY item_id, doc_id),
 bm AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20),
 fx AS (SELECT 0 AS side, doc_id AS id, {_W.format(c="text")} AS w FROM documents UNION ALL SELECT 1, item_id, {_W.format(c="text")} FROM benchmark),
 fe AS (SELECT side, id, 'w:' || x AS f FROM (SELECT side, id, unnest(w) AS x FROM fx) UNION ALL SELECT side, id, 'wb:' || w[i] || '_' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM fx WHERE len(w) > 1)),
 fn AS (SELECT side, id, f, count(*) AS n FROM fe GROUP BY ALL),
 fv AS (SELECT f, ('0x' || substr(md5(f), 1, 8))::BIGINT % 384 AS bucket, CASE WHEN substr(md5(f), 9, 1) IN ('1','3','5','7','9','b','d','f') THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT f FROM fn)),
 fr AS (SELECT side, id, bucket, sum(sign::DOUBLE * (1 + ln(n))) AS v FROM fn JOIN fv USING (f) GROUP BY ALL),
 fl AS (SELECT side, id, sqrt(sum(v * v)) AS norm FROM fr GROUP BY ALL), fw AS (SELECT side, id, bucket, v / norm AS v FROM fr JOIN fl USING (side, id) WHERE norm > 0),
 fd AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.v * d.v), 6) AS score FROM fw q JOIN fw d USING (bucket) WHERE q.side = 1 AND d.side = 0 GROUP BY ALL),
 dn AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fd WHERE score > 0 QUALIFY rank <= 20) """


def bm(table, k=20):
    return retrieval.bm25(table("benchmark"), table("documents"), "item_id", "text", "doc_id", {"text": 1}, k)


def dense_docs(table, k=20):
    """Documents nearest to each question by hashed feature vectors of both texts, with a cosine above 0."""
    q = retrieval.hash_vectors(table("benchmark"), "item_id", "text")
    d = retrieval.hash_vectors(table("documents"), "doc_id", "text")
    return retrieval.dense_topk(q, d, k, id_col="doc_id", query_col="item_id").where("score > 0").withColumnsRenamed({"query_id": "item_id", "id": "doc_id"})


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_W.format(c='text')}) AS term FROM documents) GROUP BY ALL")
def i1_tokenize(spark, table):
    return table("documents").select("doc_id", F.explode(retrieval.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(_BASE + "SELECT term, df, sum(tf)::BIGINT AS cf, n AS n_docs, round(avg_len, 6) AS average_length FROM tf JOIN dfr USING (term), st GROUP BY ALL")
def i2_postings(spark, table):
    d = table("documents")
    p = retrieval.postings(d, "doc_id", {"text": 1})
    s = retrieval.corpus_stats(d, p, "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(s)).select("term", "df", "cf", "n_docs", F.round("average_length", 6).alias("average_length"))


@query(f"""WITH d AS (SELECT doc_id, {_W.format(c="text")} AS w FROM documents),
 f AS (SELECT doc_id, 'w:' || x AS f FROM (SELECT doc_id, unnest(w) AS x FROM d) UNION ALL SELECT doc_id, 'wb:' || w[i] || '_' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)),
 n AS (SELECT doc_id, f, count(*) AS n FROM f GROUP BY ALL), v AS (SELECT f, ('0x' || substr(md5(f), 1, 8))::BIGINT % 384 AS bucket, CASE WHEN substr(md5(f), 9, 1) IN ('1','3','5','7','9','b','d','f') THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT f FROM n)),
 r AS (SELECT doc_id, bucket, sum(sign::DOUBLE * (1 + ln(n))) AS v FROM n JOIN v USING (f) GROUP BY ALL), z AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM r GROUP BY doc_id)
 SELECT doc_id, count(*) AS n_buckets, round(sum(v / norm * bucket), 3) AS checksum FROM r JOIN z USING (doc_id) WHERE norm > 0 GROUP BY doc_id""")
def i3_hash_embed(spark, table):
    h = retrieval.hash_embed(table("documents"), "doc_id", "text")
    return h.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.round(F.sum(F.col("value") * F.col("bucket")), 3).alias("checksum"))


@query(_BASE + "SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 5")
def r1_bm25_topk(spark, table):
    """Flagship: the five best documents for every benchmark question."""
    return bm(table, 5)


_FILTERED = f"""WITH q AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['de', 'fr'] WHEN 2 THEN [] ELSE ['es'] END AS langs, CASE WHEN item_id % 3 = 0 THEN [] ELSE ['src' || (item_id % 5), 'src' || (item_id % 5 + 7)] END AS sources FROM benchmark),
 m AS (SELECT item_id, doc_id, d.text FROM q, documents d WHERE (len(langs) = 0 OR list_contains(langs, lang)) AND (len(sources) = 0 OR list_contains(sources, source))),
 dt AS (SELECT doc_id, unnest({_W.format(c="text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL),
 st AS (SELECT item_id, count(*) AS n, sum(coalesce(len, 0)) / count(*) AS avg_len FROM m LEFT JOIN dl USING (doc_id) GROUP BY item_id),
 qt AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_W.format(c="text")}) AS term FROM benchmark) GROUP BY ALL),
 h AS (SELECT m.item_id, m.doc_id, tf.term, tf, len, qn FROM m JOIN qt ON m.item_id = qt.item_id JOIN tf ON tf.doc_id = m.doc_id AND tf.term = qt.term JOIN dl ON dl.doc_id = m.doc_id),
 f AS (SELECT item_id, term, count(*) AS df FROM h GROUP BY ALL),
 sc AS (SELECT h.item_id, h.doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM h JOIN f ON f.item_id = h.item_id AND f.term = h.term JOIN st ON st.item_id = h.item_id GROUP BY ALL)
 SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10"""


@query(_FILTERED)
def r1_bm25_filtered(spark, table):
    """Every question within documents of its own languages and sources."""
    i = F.col("item_id")
    empty = F.array().cast("array<string>")
    langs = F.when(i % 4 == 0, F.array(F.lit("EN"))).when(i % 4 == 1, F.array(F.lit("de"), F.lit("fr"))).when(i % 4 == 2, empty).otherwise(F.array(F.lit("es")))
    sources = F.when(i % 3 == 0, empty).otherwise(F.array(F.concat(F.lit("src"), (i % 5).cast("string")), F.concat(F.lit("src"), (i % 5 + 7).cast("string"))))
    q = table("benchmark").select("item_id", "text", langs.alias("any_lang"), sources.alias("any_source"))
    return retrieval.bm25_filtered(q, table("documents"), "item_id", "text", "doc_id", {"text": 1}, 10, {"any_lang": "lang", "any_source": "source"})


_DENSE = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, label FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.n > 0 AND v.n > 0 AND len(q.e) = len(v.e)),
 d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10),
 g AS (SELECT q.vec_id AS query_id, e.vec_id AS id, CASE WHEN q.vec_id = e.vec_id THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0) """


def dense(table, k=10):
    e = table("embeddings")
    return retrieval.dense_topk(e.where("vec_id % 100 = 0"), e, k)


def gold(table):
    e = table("embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id", F.when(F.col("query_id") == F.col("id"), 2).otherwise(1).alias("grade"))


@query(_DENSE + "SELECT query_id, id, score, rank FROM d")
def r2_dense_topk(spark, table):
    return dense(table)


@query(_BASE + """, u AS (SELECT *, 0 AS l FROM bm UNION ALL SELECT *, 1 FROM dn), f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min(rank) AS best_rank, min(l * 1000 + rank) AS seen FROM u GROUP BY ALL)
 SELECT item_id, doc_id, rrf_score, best_rank, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, best_rank, seen, doc_id) AS rank FROM f""")
def r3_rrf_fuse(spark, table):
    return retrieval.rrf_fuse([bm(table), dense_docs(table)], "item_id", "doc_id")


@query(_BASE + """, j AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS bm25_rank, b.rank AS dense_rank FROM bm a FULL OUTER JOIN dn b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
 s AS (SELECT *, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 6) AS score FROM j)
 SELECT item_id, doc_id, bm25_rank, dense_rank, score, concat_ws('+', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS methods,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, coalesce(bm25_rank, 1000000000), coalesce(dense_rank, 1000000000), doc_id) AS rank FROM s""")
def r4_hybrid_join(spark, table):
    return retrieval.hybrid_join(bm(table), dense_docs(table), "item_id", "doc_id")


@query(_BASE + """, u AS (SELECT item_id, doc_id, rank AS o FROM bm UNION ALL SELECT item_id, doc_id, 1000 + rank FROM dn), m AS (SELECT item_id, doc_id, min(o) AS o FROM u GROUP BY ALL)
 SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY o) AS rank FROM m QUALIFY rank <= 25""")
def r5_concat_unique(spark, table):
    return retrieval.concat_unique([bm(table), dense_docs(table)], "item_id", "doc_id", 25)


_LEX = """ toks AS (SELECT c.item_id, c.doc_id, c.score, c.rank, b.text AS q, d.text AS t, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+(?:[._+#/-][a-z0-9]+)*')) AS qa, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+(?:[._+#/-][a-z0-9]+)*')) AS da
   FROM bm c JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
 cm AS (SELECT *, len(list_intersect(qa, da)) AS common FROM toks),
 lx AS (SELECT item_id, doc_id, score, rank, round(CASE WHEN len(qa) = 0 THEN 0 ELSE least(1.0, 0.7 * common / len(qa) + 0.2 * common / (len(qa) + len(da) - common) + CASE WHEN contains(regexp_replace(lower(t), '\\s+', '', 'g'), regexp_replace(lower(q), '\\s+', '', 'g')) THEN 0.1 ELSE 0 END) END + 1e-9, 6) AS rerank_score FROM cm),
 rr AS (SELECT item_id, doc_id, score, rerank_score, round(0.75 * rerank_score + 0.25 * CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) WHEN max(score) OVER p > 0 THEN 1.0 ELSE 0.0 END + 1e-9, 6) AS final_score FROM lx WINDOW p AS (PARTITION BY item_id)) """


def ranked(table):
    """The first documents of every question, written: a small table, which joins send to the documents, whose texts stay where they are."""
    return written(bm(table), "bm25")


def candidates(table, first=None):
    return (ranked(table) if first is None else first).join(table("benchmark").withColumnRenamed("text", "question"), "item_id").join(table("documents").select("doc_id", "text", "source", "n_chars"), "doc_id")


@query(_BASE + "," + _LEX + "SELECT item_id, doc_id, rerank_score, final_score, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, doc_id) AS rank FROM rr")
def r6_lexical_rerank(spark, table):
    return retrieval.lexical_rerank(candidates(table), "item_id", "doc_id", "question", "text").select("item_id", "doc_id", "rerank_score", "final_score", "rank")


@query("""WITH e AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, event_type = 'purchase' AS is_current, user_id % 3 = 0 AS latest, user_id % 3 = 1 AS hist, event_id % 2 = 0 AS inside,
   CASE WHEN event_id % 11 = 0 THEN 0.25 ELSE exp(-ln(2.0) * greatest(date_diff('day', ts::DATE, DATE '2024-06-30'), 0) / 180.0) END AS r FROM events)
 SELECT event_id, round(CASE WHEN latest THEN r WHEN hist THEN CASE WHEN inside THEN 0.6 ELSE 0.0 END ELSE 0.5 + 0.5 * r END, 6) AS time_score,
   round(CASE WHEN latest THEN CASE WHEN is_current THEN 1.0 ELSE 0.0 END WHEN hist THEN CASE WHEN is_current THEN 0.2 ELSE 1.0 END ELSE CASE WHEN is_current THEN 1.0 ELSE 0.5 END END, 6)::DOUBLE AS version_score FROM e""")
def r7_temporal_rank(spark, table):
    e = table("events").withColumn("published", F.when(F.col("event_id") % 11 != 0, F.to_date("ts"))).withColumn("is_current", F.col("event_type") == "purchase")
    out = retrieval.temporal_scores(e, F.lit("2024-06-30").cast("date"), "published", "is_current", F.col("user_id") % 3 == 0, F.col("user_id") % 3 == 1, F.col("event_id") % 2 == 0)
    return out.select("event_id", "time_score", "version_score")


_ASKED = """ , a AS (SELECT 'now' AS q, 'the latest state' AS question, NULL::TIMESTAMP AS as_of UNION ALL SELECT 'then', 'what held at that time', TIMESTAMP '2024-03-01' UNION ALL SELECT 'once', 'its history', NULL UNION ALL SELECT 'any', 'anything', NULL),
 c AS (SELECT q, question, as_of, user_id, version_no, n_seen::DOUBLE AS score, valid_from, valid_to, valid_to IS NULL AS cur FROM h, a WHERE event_type = 'purchase'),
 k AS (SELECT *, (as_of IS NULL OR (valid_from <= as_of AND (valid_to IS NULL OR as_of < valid_to))) AS inside, exp(-ln(2.0) * greatest((epoch_us(TIMESTAMP '2024-06-30') - epoch_us(valid_from)) / 86400000000.0, 0) / 180.0) AS fresh FROM c),
 s AS (SELECT *, round(CASE WHEN q = 'then' THEN 1.0 WHEN q = 'now' THEN fresh WHEN q = 'once' THEN 0.6 ELSE 0.5 + 0.5 * fresh END, 6) AS time_score, round(CASE WHEN q = 'then' THEN 1.0 WHEN q = 'now' THEN CASE WHEN cur THEN 1.0 ELSE 0.0 END WHEN q = 'once' THEN CASE WHEN cur THEN 0.2 ELSE 1.0 END ELSE CASE WHEN cur THEN 1.0 ELSE 0.5 END END, 6)::DOUBLE AS version_score FROM k WHERE inside),
 t AS (SELECT *, round(0.67 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END + 0.25 * time_score + 0.08 * version_score + 1e-9, 6) AS final_score FROM s WINDOW w AS (PARTITION BY q)),
 r AS (SELECT *, user_id || '-' || version_no AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY final_score DESC, user_id || '-' || version_no) AS rank FROM t) """


def _asked_sql():
    from .prepare import _HISTORY

    return _HISTORY + _ASKED


@query(_asked_sql() + "SELECT q, chunk_id, time_score, version_score, final_score, rank FROM r")
def r7_temporal_versions(spark, table):
    """Purchases as versioned states, ranked for a question about now, one about a day, one about the past and one about nothing in particular."""
    from .prepare import history

    asked = spark.createDataFrame([("now", "the latest state", None), ("then", "what held at that time", "2024-03-01 00:00:00"), ("once", "its history", None), ("any", "anything", None)], "q string, question string, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    h = history(table).where("event_type = 'purchase'")
    c = h.select(F.concat_ws("-", "user_id", "version_no").alias("chunk_id"), F.col("n_seen").cast("double").alias("score"), F.col("valid_from").alias("publish_time"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), F.lit(None).cast("string").alias("product_version"))
    none = {"current_only": F.lit(False), "versions": F.array().cast("array<string>"), "start_time": F.lit(None).cast("timestamp"), "end_time": F.lit(None).cast("timestamp")}
    out = retrieval.temporal_rank(c.crossJoin(F.broadcast(asked)).withColumns(none), "q", "chunk_id", F.lit("2024-06-30").cast("timestamp"))
    return out.select("q", "chunk_id", "time_score", "version_score", "final_score", "rank")


@query(_BASE + """ SELECT item_id, doc_id, round(0.85 * CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.55 ELSE 0.3 END + 0.15 * CASE WHEN count(source) OVER (PARTITION BY item_id, source) > 1 THEN 1 ELSE 0 END, 6)::DOUBLE AS evidence_score FROM bm JOIN documents USING (doc_id)""")
def r8_authority_rank(spark, table):
    c = ranked(table).join(table("documents").select("doc_id", "source"), "doc_id")
    c = c.withColumn("level", F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.substring("source", 4, 9).cast("int") % 4))
    return retrieval.authority(c, "item_id", "level", "source").select("item_id", "doc_id", "evidence_score")


@query(_BASE + "," + _LEX + """, b AS (SELECT item_id, doc_id, round(0.70 * final_score + 0.12 * 0.5 + 0.08 * CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END + 0.10 * rerank_score, 8)::DOUBLE AS final_score FROM rr)
 SELECT item_id, doc_id, final_score, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, doc_id) AS rank FROM b""")
def r9_blend_scores(spark, table):
    c = retrieval.lexical_rerank(candidates(table), "item_id", "doc_id", "question", "text")
    c = c.withColumns({"semantic": F.col("final_score"), "temporal": F.lit(0.5), "version": F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.5), "evidence": F.col("rerank_score")})
    return retrieval.blend(c, "item_id", "doc_id", {"semantic": 0.70, "temporal": 0.12, "version": 0.08, "evidence": 0.10}).select("item_id", "doc_id", "final_score", "rank")


@query(_BASE + "SELECT item_id, doc_id, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) WHEN max(score) OVER p > 0 THEN 1.0 ELSE 0.0 END + 1e-9, 6) AS scaled FROM bm WINDOW p AS (PARTITION BY item_id)")
def r10_minmax_by_query(spark, table):
    return bm(table).select("item_id", "doc_id", retrieval.settle(retrieval.minmax(F.col("score"), "item_id")).alias("scaled"))


def quotes(table, k=5):
    first = ranked(table).where(F.col("rank") <= k)
    return evidence.select_quotes(candidates(table, first), "item_id", "doc_id", "question", "text").join(first.select("item_id", "doc_id", "rank"), ["item_id", "doc_id"])


_QUOTES = _BASE + """, cand AS (SELECT * FROM bm WHERE rank <= 5), seg AS (SELECT c.item_id, c.doc_id, c.rank, b.text AS q, unnest(string_split(d.text, chr(10))) AS seg, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos FROM cand c JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
 sw AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+(?:[._+#/-][a-z0-9]+)*')) AS qa, list_distinct(regexp_extract_all(lower(seg), '[a-z0-9]+(?:[._+#/-][a-z0-9]+)*')) AS da FROM seg WHERE trim(seg) <> ''),
 sv AS (SELECT *, len(list_intersect(qa, da)) AS common FROM sw),
 sx AS (SELECT *, round(CASE WHEN len(qa) = 0 THEN 0 ELSE least(1.0, 0.7 * common / len(qa) + 0.2 * common / (len(qa) + len(da) - common) + CASE WHEN contains(regexp_replace(lower(seg), '\\s+', '', 'g'), regexp_replace(lower(q), '\\s+', '', 'g')) THEN 0.1 ELSE 0 END) END + 1e-9, 6) AS s FROM sv),
 qu AS (SELECT item_id, doc_id, rank, left(seg, 400) AS quote, s AS quote_score FROM sx QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY s DESC, pos) = 1) """


@query(_QUOTES + "SELECT item_id, doc_id, sha256(quote) AS quote_digest, quote_score FROM qu")
def e1_select_quotes(spark, table):
    return quotes(table).select("item_id", "doc_id", F.sha2("quote", 256).alias("quote_digest"), "quote_score")


@query(_BASE + """, u AS (SELECT item_id, doc_id, rank FROM bm UNION ALL SELECT item_id, doc_id, rank + 20 FROM dn), f AS (SELECT item_id, doc_id, min(rank) AS rank FROM u GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, doc_id) AS position FROM f)
 SELECT item_id, doc_id, position, substr(sha256(item_id || '|' || doc_id), 1, 16) AS citation_id FROM p WHERE position <= 8""")
def e2_build_evidence(spark, table):
    both = bm(table).select("item_id", "doc_id", "rank").unionByName(dense_docs(table).select("item_id", "doc_id", (F.col("rank") + 20).alias("rank")))
    return evidence.build_evidence(both, "item_id", "doc_id", 8).select("item_id", "doc_id", "position", "citation_id")


@query("""WITH ev AS (SELECT conv_id AS query_id, conv_id || ':' || turn AS chunk_id, text, turn, role FROM conversations),
 ci AS (SELECT CASE WHEN turn = 3 THEN query_id + 1 ELSE query_id END AS query_id, CASE WHEN turn = 2 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id, text, turn FROM ev)
 SELECT c.query_id, c.chunk_id, concat_ws(',', CASE WHEN e.chunk_id IS NULL THEN 'unknown_chunk' END, CASE WHEN e.query_id <> c.query_id THEN 'out_of_scope' END, CASE WHEN c.turn = 1 THEN 'quote_absent' END, CASE WHEN e.turn = 4 THEN 'char_end_mismatch' END) AS findings,
  concat_ws(',', CASE WHEN e.chunk_id IS NOT NULL AND trim(c.text) = '' AND c.turn <> 1 THEN 'no_quote' END, CASE WHEN e.role <> 'user' THEN 'weak_level' END) AS warnings FROM ci c LEFT JOIN ev e USING (chunk_id)""")
def e3_validate_citations(spark, table):
    ev = table("conversations").select(F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "text", "turn", F.col("role").alias("title"), F.length("text").alias("char_end"), F.when(F.col("role") == "user", "A").otherwise("C").alias("evidence_level"))
    t = F.col("turn")
    quote = F.when(t == 1, F.concat(F.lit("zz"), "text")).when((t == 0) & (F.length("text") >= 40), F.concat(F.upper(F.substring("text", 1, 10)), F.lit("…"), F.right("text", F.lit(5)))).otherwise(F.col("text"))
    ci = ev.select(F.when(t == 3, F.col("query_id") + 1).otherwise(F.col("query_id")).alias("query_id"), F.when(t == 2, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id"), quote.alias("quote"), F.upper("title").alias("title"), F.when(t == 4, F.col("char_end") + 1).otherwise(F.col("char_end")).alias("char_end"))
    return evidence.validate_citations(ci, ev).select("query_id", "chunk_id", F.concat_ws(",", "findings").alias("findings"), F.concat_ws(",", "warnings").alias("warnings"))


def _facts(table):
    from .prepare import history

    h = history(table).withColumn("chunk_id", F.concat_ws("-", "user_id", "version_no")).withColumn("pair", F.floor(F.col("user_id") / 2))
    return evidence.extract_facts(h, "chunk_id", {"state": F.col("event_type"), "big": F.when(F.col("n_seen") > 1, F.lit("yes"))}, ["pair", "valid_from", "valid_to"])


def _fact_sql():
    from .prepare import _HISTORY

    return _HISTORY + ", fa AS (SELECT user_id || '-' || version_no AS chunk_id, user_id // 2 AS pair, valid_from, valid_to, 'state' AS field, event_type AS value FROM h UNION ALL SELECT user_id || '-' || version_no, user_id // 2, valid_from, valid_to, 'big', 'yes' FROM h WHERE n_seen > 1) "


@query(_fact_sql() + "SELECT chunk_id, pair, field, value FROM fa")
def e4_extract_facts(spark, table):
    return _facts(table).select("chunk_id", "pair", "field", "value")


@query("""SELECT o_orderkey AS chunk_id, o_orderpriority AS entity, 'price_value' AS field, o_totalprice::DECIMAL(15, 2)::VARCHAR AS value FROM orders WHERE o_orderpriority <> '' UNION ALL SELECT o_orderkey, o_custkey || '#' || o_orderkey, 'github_state', o_orderstatus FROM orders""")
def e4_stated_facts(spark, table):
    """Orders as price statements of their priority and as issues of their customer."""
    c = F.col
    o = table("orders").select(c("o_orderkey").alias("chunk_id"), F.lit("pricing").alias("source_type"), c("o_orderpriority").alias("plan_name"), c("o_totalprice").cast("decimal(15,2)").alias("price_value"), c("o_custkey").alias("repository"), c("o_orderkey").alias("github_number"), c("o_orderstatus").alias("github_state"))
    return evidence.stated_facts(o)


@query(_fact_sql() + """, p AS (SELECT a.pair, a.field, a.chunk_id AS ca, b.chunk_id AS cb, a.value AS va, b.value AS vb FROM fa a JOIN fa b ON a.pair = b.pair AND a.field = b.field AND a.chunk_id < b.chunk_id AND a.value <> b.value AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND (b.valid_to IS NULL OR a.valid_from < b.valid_to)),
 k AS (SELECT pair, field, count(*) AS n_pairs FROM p GROUP BY ALL), c AS (SELECT DISTINCT pair, field, unnest([ca, cb]) AS chunk_id FROM p), vals AS (SELECT pair, field, array_to_string(list_sort(list(DISTINCT x)), ',') AS conflict_values FROM (SELECT pair, field, unnest([va, vb]) AS x FROM p) GROUP BY ALL),
 w AS (SELECT c.pair, c.field, c.chunk_id, row_number() OVER (PARTITION BY c.pair, c.field ORDER BY (valid_to IS NULL) DESC, valid_from DESC, c.chunk_id DESC) AS n FROM c JOIN fa USING (pair, field, chunk_id))
 SELECT k.pair, k.field, n_pairs, conflict_values, (SELECT count(*) FROM c WHERE c.pair = k.pair AND c.field = k.field) AS n_chunks, w.chunk_id AS preferred FROM k JOIN vals USING (pair, field) JOIN w ON w.pair = k.pair AND w.field = k.field AND n = 1""")
def e5_detect_conflicts(spark, table):
    c = evidence.detect_conflicts(_facts(table), ["pair", "field"], "chunk_id")
    return c.select("pair", "field", "n_pairs", F.concat_ws(",", "conflict_values").alias("conflict_values"), F.size("chunks").cast("long").alias("n_chunks"), "preferred")


@query(_QUOTES + """, a AS (SELECT item_id, rank, left(trim(regexp_replace(quote, '\\s+', ' ', 'g')), 180) || ' [' || rank || ']' AS t FROM qu WHERE rank <= 3)
 SELECT item_id, sha256(string_agg(t, chr(10) ORDER BY rank)) AS answer_digest, count(*) AS n_quotes, max(rank) = count(*) AND min(rank) = 1 AS valid FROM a GROUP BY item_id""")
def e6_extractive_answers(spark, table):
    a = evidence.extractive_answers(quotes(table).withColumn("position", F.col("rank")), "item_id")
    return a.select("item_id", F.sha2("answer", 256).alias("answer_digest"), F.col("n_quotes").cast("long").alias("n_quotes"), "valid")


@query(_DENSE + """, r AS (SELECT query_id, count(*) AS n FROM g GROUP BY ALL), h AS (SELECT d.query_id, count(DISTINCT d.id) AS got, count(DISTINCT g.id) AS hit FROM d LEFT JOIN g ON d.query_id = g.query_id AND d.id = g.id GROUP BY ALL)
 SELECT r.query_id, round(coalesce(hit / n, 0), 6) AS recall, round(coalesce(hit / got, 0), 6) AS precision FROM r LEFT JOIN h USING (query_id)""")
def m1_recall_precision(spark, table):
    return evaluate.recall_precision(dense(table), gold(table), "query_id", "id", 10).select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(_DENSE + "SELECT round(avg(coalesce(rr, 0)), 6) AS mrr FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN (SELECT d.query_id, 1.0 / min(rank) AS rr FROM d JOIN g ON d.query_id = g.query_id AND d.id = g.id GROUP BY ALL) USING (query_id)")
def m2_mrr(spark, table):
    return evaluate.reciprocal_rank(dense(table), gold(table), "query_id", "id").agg(F.round(F.avg("rr"), 6).alias("mrr"))


_NDCG = """, dc AS (SELECT d.query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS x FROM d JOIN g ON d.query_id = g.query_id AND d.id = g.id GROUP BY ALL),
 ic AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM g) WHERE n <= 10 GROUP BY ALL) """


@query(_DENSE + _NDCG + "SELECT query_id, round(CASE WHEN y > 0 THEN coalesce(x, 0) / y ELSE 0 END, 6) AS ndcg FROM ic LEFT JOIN dc USING (query_id)")
def m3_ndcg(spark, table):
    return evaluate.ndcg(dense(table), gold(table), "query_id", "id", 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_BASE + "SELECT item_id, round(avg(CASE WHEN lang = 'en' AND n_chars >= 500 THEN 1.0 ELSE 0.0 END), 6) AS filter_accuracy, round(avg(CASE WHEN doc_id % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS stale_rate FROM bm JOIN documents USING (doc_id) GROUP BY item_id")
def m4_filter_accuracy(spark, table):
    c = written(ranked(table).join(table("documents").select("doc_id", "lang", "n_chars"), "doc_id"), "candidates")
    a = evaluate.share(c, "item_id", (F.col("lang") == "en") & (F.col("n_chars") >= 500)).withColumnRenamed("share", "filter_accuracy")
    s = evaluate.share(c, "item_id", F.col("doc_id") % 2 == 1).withColumnRenamed("share", "stale_rate")
    return a.join(s, "item_id").select("item_id", F.round("filter_accuracy", 6).alias("filter_accuracy"), F.round("stale_rate", 6).alias("stale_rate"))


@query(_BASE + "SELECT item_id, round(avg(CASE WHEN contains(d.text, b.text) THEN 1.0 ELSE 0.0 END), 6) AS citation_accuracy, bool_or(contains(d.text, b.text)) AS quote_present FROM bm JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) GROUP BY item_id")
def m5_citation_accuracy(spark, table):
    ok = F.col("text").contains(F.col("question"))
    return candidates(table).groupBy("item_id").agg(F.round(F.avg(ok.cast("double")), 6).alias("citation_accuracy"), F.bool_or(ok).alias("quote_present"))


@query(_fact_sql() + """, p AS (SELECT DISTINCT pair, value FROM fa WHERE field = 'state' AND pair % 3 <> 0), e AS (SELECT DISTINCT pair, value FROM fa WHERE field = 'state' AND pair % 4 <> 0 AND value <> 'view'),
 c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM p JOIN e USING (pair, value)) AS hit)
 SELECT round(hit / np, 6) AS precision, round(hit / ne, 6) AS recall, hit = np AND hit = ne AS exact_match, round(2 * (hit / np) * (hit / ne) / (hit / np + hit / ne), 6) AS f1 FROM c""")
def m6_conflict_prf(spark, table):
    f = _facts(table).where("field = 'state'").select("pair", "value")
    r = evaluate.conflict_prf(f.where("pair % 3 <> 0"), f.where("pair % 4 <> 0 and value <> 'view'"), ["pair", "value"])
    return r.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "exact_match", F.round("f1", 6).alias("f1"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1")
def m7_latency_summary(spark, table):
    return evaluate.latency_summary(table("events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")])


@query(_DENSE + _NDCG + """, r AS (SELECT query_id, count(*) AS n FROM g GROUP BY ALL), h AS (SELECT d.query_id, count(DISTINCT g.id) AS hit, min(CASE WHEN g.id IS NOT NULL THEN rank END) AS f FROM d LEFT JOIN g ON d.query_id = g.query_id AND d.id = g.id GROUP BY ALL)
 SELECT 'recall' AS metric, round(avg(coalesce(hit / n, 0)), 6) AS mean, count(*) AS n FROM r LEFT JOIN h USING (query_id) UNION ALL SELECT 'rr', round(avg(coalesce(1.0 / f, 0)), 6), count(*) FROM r LEFT JOIN h USING (query_id)
 UNION ALL SELECT 'ndcg', round(avg(CASE WHEN y > 0 THEN coalesce(x, 0) / y ELSE 0 END), 6), count(*) FROM ic LEFT JOIN dc USING (query_id)""")
def m8_evaluate(spark, table):
    d, g = dense(table), gold(table)
    long = lambda df, m: df.select("query_id", F.lit(m).alias("metric"), F.col(m).alias("value"))
    every = long(evaluate.recall_precision(d, g, "query_id", "id", 10), "recall").unionByName(long(evaluate.reciprocal_rank(d, g, "query_id", "id"), "rr")).unionByName(long(evaluate.ndcg(d, g, "query_id", "id", 10), "ndcg"))
    return every.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


@query("SELECT event_type, user_id, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS min, max(value) AS max, count(value) AS n, count(DISTINCT event_id % 2) <= 1 AS consistent FROM events GROUP BY 1, 2")
def m11_aggregate_runs(spark, table):
    r = evaluate.aggregate_runs(table("events").withColumn("inv", F.col("event_id") % 2), ["event_type", "user_id"], "value", "inv")
    return r.select("event_type", "user_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "min", "max", "n", "consistent")


@query(_BASE + """, u AS (SELECT item_id, doc_id, 'a' AS g, rank, false AS s FROM bm WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 'b', rank, false FROM dn WHERE rank <= 10 UNION ALL SELECT item_id, item_id, NULL, NULL, true FROM benchmark),
 p AS (SELECT item_id, doc_id, bool_or(s) AS seeded, min(rank) AS best_rank, count(DISTINCT g) AS n_groups FROM u GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seeded DESC, coalesce(best_rank, 1000000000), doc_id) AS position FROM p""")
def m12_candidate_pool(spark, table):
    seeds = table("benchmark").select("item_id", F.col("item_id").alias("doc_id"))
    return evaluate.candidate_pool({"a": bm(table), "b": dense_docs(table)}, seeds, "item_id", "doc_id", 10)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) ORDER BY r, source, lang, doc_id LIMIT 200")
def m17_stratified_round_robin(spark, table):
    return evaluate.round_robin(table("documents"), ["source", "lang"], "doc_id", 200).select("doc_id", "source", "lang")
