"""Queries of filters, audits, chunks, index maintenance and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, filters, html, prepare, tables as T
from ..registry import query, scratch
from .prepare import _HISTORY, _REASONS, _TITLES, _URLS, RULES, _labelled, history, label_sql

_F1 = "CASE WHEN event_type = 'view' AND event_id % 7 = 0 OR value < 5 THEN 'skip' WHEN event_type = 'error' OR value >= 180 THEN 'acquisition_failure' WHEN event_id % 5 = 0 THEN 'missing_payload' ELSE 'process' END"


@query(f"SELECT {_F1} AS route, count(*) AS n FROM events GROUP BY 1")
def f1_route_records(spark, table):
    c = F.col
    status = F.when(c("value") < 5, 304).when(c("value") >= 180, 500).otherwise(200)
    return T.route_records(table("events"), status, c("event_type") == "error", c("event_id") % 5 != 0, (c("event_type") == "view") & (c("event_id") % 7 == 0)).groupBy("route").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT * FROM (VALUES (1, ['1', '2', '3'], [], false, NULL, NULL), (2, [], ['PURCHASE', 'click'], true, NULL, NULL), (3, [], ['error'], false, DATE '2024-01-05', DATE '2024-01-20'), (4, ['7'], ['view'], false, DATE '2024-01-10', NULL)) t(query_id, s, k, cur, a, z)),
 e AS (SELECT event_id, user_id::VARCHAR AS source, event_type AS kind, event_id % 2 = 0 AS is_current, CASE WHEN event_id % 10 <> 0 THEN ts::DATE END AS p FROM events)
 SELECT query_id, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM q, e WHERE (len(s) = 0 OR list_contains(s, source)) AND (len(k) = 0 OR list_contains(list_transform(k, lambda x: lower(x)), kind)) AND (NOT cur OR is_current) AND (a IS NULL AND z IS NULL OR p IS NOT NULL AND (a IS NULL OR p >= a) AND (z IS NULL OR p <= z)) GROUP BY 1""")
def f2_metadata_filter(spark, table):
    q = spark.createDataFrame([(1, ["1", "2", "3"], [], False, None, None), (2, [], ["PURCHASE", "click"], True, None, None), (3, [], ["error"], False, "2024-01-05", "2024-01-20"), (4, ["7"], ["view"], False, "2024-01-10", None)], "query_id int, any_source array<string>, any_kind array<string>, current_only boolean, s string, e string")
    q = q.select("query_id", "any_source", "any_kind", "current_only", F.to_date("s").alias("q_start"), F.to_date("e").alias("q_end"))
    e = table("events").select("event_id", F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("kind"), (F.col("event_id") % 2 == 0).alias("is_current"), F.when(F.col("event_id") % 10 != 0, F.to_date("ts")).alias("published"))
    return filters.metadata_filter(e, q).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-21' - INTERVAL 14 DAY AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def f4_analysis_window(spark, table):
    end = F.lit("2024-01-20").cast("date") + F.expr("interval 1 day")
    return table("events").where((F.col("ts") >= (end - F.expr("interval 14 days")).cast("timestamp")) & (F.col("ts") < end.cast("timestamp"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en' AND contains(lower(text), 'that')) AS total, ceil((SELECT count(*) FROM documents WHERE lang = 'en' AND contains(lower(text), 'that')) / 25.0)::BIGINT AS pages FROM documents WHERE lang = 'en' AND contains(lower(text), 'that') ORDER BY n_chars DESC, doc_id DESC LIMIT 25 OFFSET 25")
def f5_list_documents(spark, table):
    d = table("documents").where((F.col("lang") == "en") & F.lower("text").contains("that")).select("doc_id", "source", "n_chars")
    return T.page(d, [F.col("n_chars").desc(), F.col("doc_id").desc()], 2, 25)


@query("""SELECT o_orderkey, o_orderpriority, count(*) AS n_evidence, epoch_us(max(l_shipdate)) AS latest_us FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_totalprice > 1000 AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_returnflag = 'R') GROUP BY 1, 2, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def f6_search_cards(spark, table):
    li = table("lineitem")
    o = table("orders").where("o_orderstatus = 'O' and o_totalprice > 1000").join(li.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    e = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_evidence"), F.unix_micros(F.max("l_shipdate")).alias("latest_us"))
    return o.join(e, "o_orderkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "n_evidence", "latest_us")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 5000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def f7_search_snapshots(spark, table):
    o = table("orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= 5000))
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, c_custkey IS NULL AS machine_only FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def f8_owner_scope(spark, table):
    c = table("customer")
    owned = table("orders").join(c.where("c_nationkey = 5"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", F.lit(False).alias("machine_only"))
    loose = table("orders").join(c.where("c_nationkey < 20"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", F.lit(True).alias("machine_only"))
    return owned.unionByName(loose)


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum FROM events WHERE (props->>'k')::BIGINT >= 50 GROUP BY 1")
def f9_filter_json_field(spark, table):
    e = table("events").withColumn("k", F.variant_get(F.parse_json("props"), "$.k", "bigint"))
    return e.where("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query(r"""WITH a AS (SELECT * FROM (VALUES ('than', 'A'), ('thanin', 'B'), ('ere', 'C'), ('tion', 'D')) t(alias, canonical)), q AS (SELECT item_id, lower(text) || CASE WHEN item_id % 3 = 0 THEN ' last ' || item_id || ' weeks v1.' || item_id ELSE '' END AS t FROM benchmark),
 h AS (SELECT item_id, arg_max(canonical, lpad(length(alias)::VARCHAR, 3, '0') || canonical) AS competitor FROM q JOIN a ON contains(t, alias) GROUP BY 1)
 SELECT q.item_id, competitor, concat_ws(',', CASE WHEN regexp_matches(t, '(and|und)') THEN 'join' END, CASE WHEN regexp_matches(t, '(which|que)') THEN 'ask' END) AS kinds, CASE WHEN item_id % 3 = 0 THEN '1.' || item_id ELSE '' END AS versions, CASE WHEN item_id % 3 = 0 THEN (item_id * 7)::INT END AS days FROM q LEFT JOIN h USING (item_id)""")
def f10_infer_filters(spark, table):
    q = table("benchmark").withColumn("text", F.concat("text", F.when(F.col("item_id") % 3 == 0, F.format_string(" last %d weeks v1.%d", "item_id", "item_id")).otherwise("")))
    a = spark.createDataFrame([("than", "A"), ("thanin", "B"), ("ere", "C"), ("tion", "D")], "alias string, canonical string")
    r = T.infer_filters(q, "item_id", "text", a, {"join": ["and", "und"], "ask": ["which", "que"]})
    return r.select("item_id", "competitor", F.concat_ws(",", "kinds").alias("kinds"), F.concat_ws(",", "versions").alias("versions"), "days")


@query("""WITH s AS (SELECT * FROM (VALUES ('the', 'article', 1), ('the', 'det', 2), ('and', 'join', 3), ('of', 'det', 4)) t(term, synonym, seq)), h AS (SELECT item_id, synonym, min(seq) AS seq FROM benchmark JOIN s ON contains(lower(text), term) AND NOT contains(lower(text), synonym) GROUP BY ALL),
 g AS (SELECT item_id, string_agg(synonym, ' ' ORDER BY seq) AS x, count(*) AS n FROM h GROUP BY 1) SELECT item_id, sha256(text || coalesce(' ' || x, '')) AS digest, coalesce(n, 0)::INT AS n_added FROM benchmark LEFT JOIN g USING (item_id)""")
def f11_expand_queries(spark, table):
    s = spark.createDataFrame([("the", "article", 1), ("the", "det", 2), ("and", "join", 3), ("of", "det", 4)], "term string, synonym string, seq int")
    e = T.expand_queries(table("benchmark"), "item_id", "text", s)
    return e.select("item_id", F.sha2("expanded", 256).alias("digest"), "n_added")


# shortest contents by top-level domain
MINIMA = {"org": 1500, "net": 1200}
_A1 = _URLS + f""", ti AS ({_TITLES}), d AS (SELECT ca.page_id AS doc_id, ca.url, canonical_url, title, length(html) AS n, regexp_extract(ca.url, '^[a-z]+://[^/?#]*[.]([a-z]+)', 1) AS source_type FROM ca JOIN ti USING (page_id) JOIN pages USING (page_id)),
 fi AS (SELECT doc_id, source_type, list_filter([CASE WHEN NOT regexp_matches(lower(url), '^https?://[^/?#]+') THEN 'url_invalid' WHEN url <> canonical_url THEN 'url_not_canonical' END, CASE WHEN n < CASE source_type WHEN 'org' THEN 1500 WHEN 'net' THEN 1200 ELSE 1000 END THEN 'too_short' END, CASE WHEN title IS NULL THEN 'untitled' END], lambda x: x IS NOT NULL) AS f FROM d) """


def content_findings(table):
    p = table("pages")
    d = p.select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("content"), F.sha2("html", 256).alias("content_hash"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*[.]([a-z]+)", 1).alias("source_type"))
    d = d.join(html.page_metadata(p).select(F.col("page_id").alias("doc_id"), "title"), "doc_id")
    return audit.content_checks(d, F.lit("2024-01-20").cast("timestamp"), MINIMA, 1000).select("doc_id", "source_type", F.col("findings").alias("f"))


@query(_A1 + "SELECT doc_id, array_to_string(f, ',') AS findings FROM fi")
def a1_content_checks(spark, table):
    return content_findings(table).select("doc_id", F.concat_ws(",", "f").alias("findings"))


@query(_HISTORY + """SELECT user_id, version_no, concat_ws(',', CASE WHEN valid_from > TIMESTAMP '2024-01-21' OR valid_to > TIMESTAMP '2024-01-21' THEN 'future_time' END, CASE WHEN valid_to < valid_from THEN 'bad_interval' END) AS findings FROM h""")
def a1_interval_checks(spark, table):
    h = audit.content_checks(history(table).select("user_id", "version_no", "valid_from", "valid_to", "is_current"), F.lit("2024-01-20").cast("timestamp"))
    return h.select("user_id", "version_no", F.concat_ws(",", "findings").alias("findings"))


_NO = r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), rl AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, line FROM l WHERE length(line) >= 20 GROUP BY 1, 2 HAVING count(*) >= 3)),
 nf AS (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)<\s*/?\s*(?:script|style|nav|footer|header|button|input|select|option)\b') THEN 'html_artifact' END, CASE WHEN regexp_matches(text, '(?i)\b(?:accept all cookies|manage cookie preferences|cookie settings)\b') THEN 'cookie_banner' END, CASE WHEN regexp_matches(text, '(?i)(?:^|\n)\s*(?:skip to content|back to top)\s*(?:\n|$)') THEN 'navigation' END, CASE WHEN rl.doc_id IS NOT NULL THEN 'repeated_line' END) AS flags FROM documents LEFT JOIN rl USING (doc_id)) """


@query(_NO + "SELECT doc_id, flags FROM nf WHERE flags <> ''")
def a2_noise_flags(spark, table):
    d = table("documents")
    r = T.repeated_lines(d).withColumn("_r", F.lit("repeated_line"))
    every = F.concat(T.flags(F.col("text"), T.NOISE), F.array_compact(F.array("_r")))
    return d.join(r, "doc_id", "left").select("doc_id", F.array_join(every, ",").alias("flags")).where("flags <> ''")


@query(r"""WITH s AS (SELECT source, [CASE WHEN regexp_matches(text, '(?i)(?:^|[^\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(text, '(?:^|[^\w+])\+\d(?:[ ()-]*\d){7,14}(?:[^\d]|$)|(?:^|\D)(?:\(\d{2,4}\)|\d{2,4})[ -]\d{3,4}[ -]\d{3,4}(?:\D|$)') THEN 'phone' END,
 CASE WHEN regexp_matches(text, '(?:^|\D)\d{12,}(?:\D|$)') THEN 'long_number' END, CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END, CASE WHEN regexp_matches(text, '\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})\b') THEN 'token' END, CASE WHEN regexp_matches(text, '(?i)\b[A-Z]:\\(?:Users|Documents and Settings)\\[^\s\\]+') THEN 'user_path' END] AS f FROM documents)
 SELECT source, flag, count(*) AS n FROM (SELECT source, unnest(f) AS flag FROM s) WHERE flag IS NOT NULL GROUP BY 1, 2""")
def a3_sensitive_flags(spark, table):
    return table("documents").select("source", F.explode(T.flags(F.col("text"), T.SENSITIVE)).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))


# what the labels were stored by: the rules before their last terms came in
EARLIER = {d: terms[:-1] for d, terms in RULES.items()}


def _drift_sql():
    kept = lambda name, rules: f"{name} AS ({label_sql(rules)} SELECT doc_id, event_type, tags, round(conf, 6) AS conf, {_REASONS} AS reasons, len(tags) = 0 OR conf < 0.55 AS needs_review FROM c)"
    unlike = lambda x, code: f"CASE WHEN s.{x} IS DISTINCT FROM n.{x} THEN '{code}' END"
    both = ", ".join(unlike(*p) for p in (("event_type", "event_mismatch"), ("tags", "dimension_mismatch"), ("conf", "confidence_mismatch"), ("reasons", "reasons_mismatch"), ("needs_review", "review_flag_mismatch")))
    weak = "CASE WHEN len(s.tags) = 0 THEN 'no_dimension' WHEN n.needs_review THEN 'low_confidence' END"
    return f"WITH {kept('s', EARLIER)}, {kept('n', RULES)} SELECT doc_id, concat_ws(',', {both}, {weak}) AS findings FROM s JOIN n USING (doc_id)"


@query(_drift_sql())
def a4_label_drift(spark, table):
    return audit.label_drift(_labelled(table, EARLIER), _labelled(table)).select("doc_id", F.concat_ws(",", "findings").alias("findings"))


@query(_URLS + """, f AS (SELECT canonical_url, min(page_id) AS page_id FROM ca GROUP BY 1), p AS (SELECT ca.page_id, ca.canonical_url, ca.url, html FROM ca JOIN pages USING (page_id)), r AS (SELECT p.* FROM p JOIN f USING (page_id))
 SELECT p.page_id, concat_ws(',', CASE WHEN p.url <> r.url THEN 'path_mismatch' END, CASE WHEN p.html IS DISTINCT FROM r.html THEN 'document_hash_mismatch' END) AS findings FROM p JOIN r USING (canonical_url)""")
def a6_lineage_checks(spark, table):
    """Every page against the first capture of its canonical address."""
    p = table("pages").select("page_id", F.col("url").alias("path"), prepare.canonical_url(F.col("url")).alias("raw_record_id"), F.sha2("html", 256).alias("digest"))
    p = p.withColumns({"source_type": F.lit("page"), "competitor": F.regexp_extract("raw_record_id", r"^[a-z]+://([^/?#]*)", 1)})
    first = p.groupBy("raw_record_id").agg(F.min_by(F.struct("path", "digest", "source_type", "competitor"), "page_id").alias("x")).select("raw_record_id", "x.*", F.lit(None).cast("string").alias("error"), F.lit(200).alias("http_status"), F.col("x.digest").alias("payload_hash"))
    docs = p.select("page_id", "raw_record_id", F.col("path").alias("raw_path"), "source_type", "competitor", F.col("digest").alias("payload_hash"))
    return audit.lineage_checks(docs, first, "page_id").select("page_id", F.concat_ws(",", "findings").alias("findings"))


_DE = _A1 + ", de AS (SELECT doc_id, source_type, f, CASE WHEN list_contains(f, 'url_invalid') OR list_contains(f, 'url_not_canonical') THEN 'FAIL' WHEN len(f) > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS decision FROM fi) "


def decisions(table):
    c = content_findings(table)
    return T.decide(c.select("doc_id", F.explode("f").alias("finding")), c, dict.fromkeys(audit.FAILS, "fail"))


@query(_DE + "SELECT doc_id, decision, array_to_string(list_sort(f), ',') AS findings FROM de")
def a7_audit_decision(spark, table):
    return decisions(table).select("doc_id", "decision", F.concat_ws(",", "findings").alias("findings"))


@query(_DE + "SELECT 'decision' AS scope, k.code AS code, count(de.doc_id) AS n FROM (VALUES ('PASS'), ('FAIL'), ('NEEDS_REVIEW')) k(code) LEFT JOIN de ON decision = code GROUP BY 2 UNION ALL SELECT 'finding', x, count(*) FROM (SELECT unnest(f) AS x FROM de) GROUP BY 2 UNION ALL SELECT 'source', source_type, count(*) FROM de GROUP BY 2")
def a8_audit_summary(spark, table):
    d = decisions(table)
    codes = spark.createDataFrame([("PASS",), ("FAIL",), ("NEEDS_REVIEW",)], "code string")
    a = codes.join(d.groupBy(F.col("decision").alias("code")).agg(F.count("*").alias("n")), "code", "left").select(F.lit("decision").alias("scope"), "code", F.coalesce("n", F.lit(0)).alias("n"))
    a = a.unionByName(content_findings(table).groupBy(F.col("source_type").alias("code")).agg(F.count("*").alias("n")).select(F.lit("source").alias("scope"), "code", "n"))
    return a.unionByName(d.select(F.explode("findings").alias("code")).groupBy("code").agg(F.count("*").alias("n")).select(F.lit("finding").alias("scope"), "code", "n"))


@query(r"""SELECT doc_id, sha256(left(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g'), '(?i)\b(api[_ -]?key|authorization|bearer|token|secret)\b\s*[:=]?\s*[^\s,;]+', '\1=[REDACTED]', 'g'), '(?is)\bprompt\b\s*[:=].*$', 'prompt=[REDACTED]', 'g'), 1000)) AS digest FROM documents""")
def a9_redact_secrets(spark, table):
    return table("documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


_CH = """WITH ch AS (SELECT doc_id, i AS chunk_index, i * 1040 AS char_start, substr(text, i * 1040 + 1, 1200) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1040 + 1)) AS i FROM documents WHERE text <> '')), ck AS (SELECT * FROM ch WHERE chunk_index = 0 OR length(content) >= 80),
 ci AS (SELECT *, char_start + length(content) AS char_end, substr(sha256(doc_id || '|' || char_start || '|' || content), 1, 24) AS chunk_id FROM ck) """


@query(_CH + "SELECT doc_id, chunk_index::INT AS chunk_index, char_start::INT AS char_start, char_end::INT AS char_end, chunk_id FROM ci")
def c2_fixed_chunks(spark, table):
    return T.fixed_chunks(table("documents")).drop("content")


@query(_CH + ", b AS (SELECT doc_id, chunk_id, CASE WHEN doc_id % 10 = 1 THEN char_start + 1 ELSE char_start END AS s, CASE WHEN doc_id % 10 = 2 THEN char_end + 1 ELSE char_end END AS e, content FROM ci) "
 "SELECT chunk_id, 'slice_mismatch' AS finding FROM b JOIN documents USING (doc_id) WHERE substr(text, s + 1, e - s) <> content UNION ALL SELECT chunk_id, 'length_mismatch' FROM b WHERE length(content) <> e - s UNION ALL SELECT chunk_id, 'duplicate_id' FROM b GROUP BY 1 HAVING count(*) > 1")
def c7_chunk_integrity(spark, table):
    d = table("documents")
    c = T.fixed_chunks(d)
    k = F.col("doc_id") % 10
    c = c.withColumn("char_start", F.when(k == 1, F.col("char_start") + 1).otherwise(F.col("char_start"))).withColumn("char_end", F.when(k == 2, F.col("char_end") + 1).otherwise(F.col("char_end")))
    return T.chunk_integrity(c, d)


@query(_CH + """, a AS (SELECT doc_id || ':' || chunk_index AS id, content, doc_id % 3 AS m FROM ci WHERE doc_id % 11 <> 0), b AS (SELECT doc_id || ':' || chunk_index AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN content || 'x' ELSE content END AS content, CASE WHEN doc_id % 7 = 0 THEN 9 ELSE doc_id % 3 END AS m FROM ci WHERE doc_id % 13 <> 0)
 SELECT CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'delete' WHEN a.content <> b.content THEN 'reembed' WHEN a.m <> b.m THEN 'metadata' ELSE 'unchanged' END AS action, count(*) AS n FROM a FULL OUTER JOIN b ON a.id = b.id GROUP BY 1""")
def i4_sync_index(spark, table):
    c = T.fixed_chunks(table("documents")).withColumn("id", F.concat_ws(":", "doc_id", "chunk_index"))
    d = F.col("doc_id")
    a = c.where(d % 11 != 0).select("id", "content", (d % 3).alias("m"))
    b = c.where(d % 13 != 0).select("id", F.when((d % 2 == 0) & (d % 5 == 0), F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"), F.when(d % 7 == 0, F.lit(9)).otherwise(d % 3).alias("m"))
    return T.sync_index(a, b, "id", "content", ["m"]).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS text_hash, length(text) AS n_chars FROM documents")
def i5_embed_distinct(spark, table):
    return T.embed_distinct(table("documents").select("doc_id", "text"), "doc_id", "text", lambda d: d.select("text_hash", F.length("text").alias("n_chars")))


@query("SELECT len(embedding) AS dim, count(*) AS n, len(embedding) = (SELECT len(embedding) FROM embeddings LIMIT 1) AS matches FROM embeddings GROUP BY 1")
def i7_vector_space_check(spark, table):
    e = table("embeddings")
    first = F.broadcast(e.select(F.size("embedding").alias("_q")).limit(1))
    return e.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).crossJoin(first).select("dim", "n", (F.col("dim") == F.col("_q")).alias("matches"))


@query("SELECT user_id, event_id, event_type FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 100)")
def s13_latest_trace(spark, table):
    return T.latest(table("events"), ["user_id"], [F.col("event_id").desc()]).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("user_id", "event_id", "event_type")


@query("""WITH j AS (SELECT l.*, o_totalprice, o_orderpriority, o_orderstatus FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_partkey, arg_max(l_orderkey, (o_totalprice, l_orderkey)) AS card, count(DISTINCT o_orderpriority) AS n_titles, count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS disagrees, count(DISTINCT l_orderkey) AS n_cards FROM j GROUP BY 1""")
def g1_evidence_index(spark, table):
    o = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderpriority")
    return T.evidence_index(o, table("lineitem"), "l_orderkey", "l_partkey", [F.col("o_totalprice").desc(), F.col("l_orderkey").desc()], "o_orderpriority", ["l_returnflag", "l_linestatus"])


@query("""WITH r AS (SELECT o_orderkey AS k, 'low_total' AS rule FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT o_orderkey, 'no_evidence' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 'LOW_TOTAL' FROM lineitem WHERE l_extendedprice < 1000)
 SELECT DISTINCT k, lower(rule) AS rule FROM r""")
def g2_review_items(spark, table):
    o, li = table("orders"), table("lineitem")
    a = o.where("o_totalprice < 2000").select(F.col("o_orderkey").alias("k"), F.lit("low_total").alias("rule"), F.lit(0).alias("seq"))
    b = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("k"), F.lit("no_evidence").alias("rule"), F.lit(1).alias("seq"))
    c = li.where("l_extendedprice < 1000").select(F.col("l_orderkey").alias("k"), F.lit("LOW_TOTAL").alias("rule"), F.lit(2).alias("seq"))
    u = a.unionByName(b).unionByName(c).withColumn("low", F.lower("rule"))
    return T.latest(u, ["k", "low"], [F.col("seq")]).select("k", F.col("low").alias("rule"))


@query("SELECT count(DISTINCT o_orderkey) AS n_cards, count(DISTINCT l_partkey) AS n_evidence, count(DISTINCT o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS n_red, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS lead FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def g3_headline_counts(spark, table):
    j = table("orders").join(table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.countDistinct("o_orderkey").alias("n_cards"), F.countDistinct("l_partkey").alias("n_evidence"), F.countDistinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("n_red"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("lead"))


@query("""WITH t AS (SELECT c_mktsegment AS product, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT product, y::INT AS y, n, n - lag(n) OVER (PARTITION BY product ORDER BY y) AS change FROM t""")
def g4_trend_series(spark, table):
    t = table("orders").join(table("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("product"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return t.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("product").orderBy("y")))


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (quality = {q} AND toxic = {t}) AS q{q}t{t}" for q in (0, 1) for t in (0, 1)) + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g5_mode_counts(spark, table):
    d = table("documents").join(table("labels"), "doc_id", "left").withColumn("m", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")))
    return d.groupBy("lang").pivot("m", ["q0t0", "q0t1", "q1t0", "q1t1"]).count().na.fill(0)


@query("""SELECT user_id, count(DISTINCT event_type) AS n_branches, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status, count(*) FILTER (value > 150) AS warnings FROM events GROUP BY 1""")
def g6_workflow_status(spark, table):
    bad = F.col("event_type") == "error"
    g = table("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_branches"), F.count_if(bad).alias("_b"), F.count_if(~bad).alias("_g"), F.count_if(F.col("value") > 150).alias("warnings"))
    return g.select("user_id", "n_branches", F.when(F.col("_b") == 0, "success").when(F.col("_g") == 0, "failed").otherwise("partial").alias("status"), "warnings")


@query("SELECT 'order_without_customer' AS \"check\", o_custkey::VARCHAR AS key, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) GROUP BY 2 UNION ALL SELECT 'line_without_part', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) GROUP BY 2")
def g7_reference_checks(spark, table):
    a = T.reference_checks(table("orders"), "o_custkey", table("customer").where("c_custkey % 9 <> 0"), "c_custkey", "order_without_customer")
    return a.unionByName(T.reference_checks(table("lineitem"), "l_partkey", table("part").where("p_size > 2"), "p_partkey", "line_without_part"))


@query("SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT conv_id, text FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, 'new' FROM conversations WHERE conv_id % 3 = 0) GROUP BY 1")
def g8_upsert_cards(spark, table):
    c = table("conversations").select("conv_id", "text")
    new = c.where("conv_id % 3 = 0").withColumn("text", F.lit("new"))
    return T.upsert(c, new, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n_cards, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS cards FROM lineitem GROUP BY 1")
def g9_evidence_usage(spark, table):
    return table("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_cards"), F.array_join(F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string")), ",").alias("cards"))


@query("""WITH f AS (SELECT o_orderkey, sha256('["' || o_custkey || '","' || o_orderstatus || '","' || o_orderpriority || '"]') AS fp FROM orders) SELECT fp AS fingerprint, count(*) AS n, min(o_orderkey) AS first_order FROM f GROUP BY 1 HAVING count(*) > 1""")
def g10_comparison_fingerprint(spark, table):
    fp = F.sha2(F.to_json(F.array(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")), 256)
    return table("orders").groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order")).where("n > 1")


@query("SELECT user_id, event_id, n_last FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_last FROM events)")
def t3_rate_demand(spark, table):
    from ..streaming import jobs

    return jobs.rate_batch(table("events"), "user_id", "ts", 60).select("user_id", "event_id", "n_last")


@query()
def t3_rate_stream(spark, table):
    """The events as a stream of their files, 3 requests in 6 hours; verdicts read back from the stream's sink."""
    from ..streaming import rates

    e = table("events")
    to = scratch(spark, "rates")
    e.select("event_id", "user_id", "ts").write.parquet(f"{to}/in")
    stream = spark.readStream.schema(e.select("event_id", "user_id", "ts").schema).parquet(f"{to}/in")
    rates.rate_stream(stream, "user_id", "ts", "event_id", 3, 21600).writeStream.option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start(f"{to}/out", format="parquet").awaitTermination()
    return spark.read.parquet(f"{to}/out").select("event_id", "user_id", "allowed")


@query("SELECT user_id, epoch_us(max(ts)) AS last_us, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS lost FROM events GROUP BY 1")
def t4_stale_batch(spark, table):
    e = table("events")
    end = F.broadcast(e.agg(F.max("ts").alias("_end")))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(end).select("user_id", F.unix_micros("last").alias("last_us"), (F.col("last") < F.col("_end") - F.expr("interval 2 hours")).alias("lost"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t6_audit_event_counts(spark, table):
    from ..streaming import jobs

    return jobs.event_counts(table("events"), "ts", "event_type", "1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n")
