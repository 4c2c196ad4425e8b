"""Queries of corpus preparation, labels and versions."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import html, labels, prepare, versions
from ..registry import query

RULES = {"D1": ["license", "licensed", "that"], "D2": ["und", "der", "die"], "D3": ["les", "des", "que"], "D4": ["worthless", "trash"], "D5": ["version", "email"]}


def _sql_hits(rules, low="low"):
    def one(t):
        return f"CASE WHEN regexp_matches({low}, '(^|[^a-z0-9]){t}(?:s|es)?([^a-z0-9]|$)') THEN '{t}' END"

    return ", ".join(f"list_filter([{', '.join(one(t) for t in ts)}], lambda x: x IS NOT NULL) AS m_{d}" for d, ts in rules.items())


def label_sql(rules):
    return f"""
 WITH d AS (SELECT doc_id, source, lower(text) AS low, CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'E1' WHEN CAST(substr(source, 4) AS INT) % 3 = 1 THEN 'E2' END AS event_type FROM documents),
 h AS (SELECT doc_id, event_type, {_sql_hits(rules)} FROM d),
 t AS (SELECT *, list_filter([{", ".join(f"CASE WHEN len(m_{d}) > 0 THEN '{d}' END" for d in rules)}], lambda x: x IS NOT NULL) AS tags, {" + ".join(f"len(m_{d})" for d in rules)} AS n_matches FROM h),
 c AS (SELECT *, CASE WHEN len(tags) = 0 THEN CASE WHEN event_type IS NOT NULL THEN 0.35 ELSE 0.0 END
        ELSE least(0.95, 0.52 + 0.08 * least(n_matches, 4) + 0.03 * least(len(tags) - 1, 3)) END AS conf FROM t)
"""


_LABEL_SQL = label_sql(RULES)


def _labelled(table, rules=RULES):
    n = F.substring("source", 4, 9).cast("int") % 3
    d = table("documents").withColumn("event_type", F.when(n == 0, "E1").when(n == 1, "E2"))
    return labels.label(d, F.col("text"), rules)


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
  '[\x00-\x09\x0B-\x1F\x7F\x{80}-\x{9F}\p{Cf}\p{Co}]', ' ', 'g'), '[ \x{A0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS digest FROM documents""")
def p1_normalize_text(spark, table):
    return table("documents").select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("digest"))


# address, canonical address of each page
_URLS = r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
   regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
 c AS (SELECT page_id, url, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END || '/' ||
   array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.'), '/') AS base,
   array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda k: k <> '' AND NOT starts_with(lower(k), 'utm_') AND NOT list_contains(['fbclid','gclid','igshid','mc_cid','mc_eid','ref_src'], lower(string_split(k, '=')[1]))), lambda k: CASE WHEN contains(k, '=') THEN k ELSE k || '=' END)), '&') AS q FROM u),
 ca AS (SELECT page_id, url, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM c) """


@query(_URLS + "SELECT canonical_url, count(*) AS n_pages, min(page_id) AS first_page FROM ca GROUP BY 1")
def p2_canonical_urls(spark, table):
    return prepare.canonical_urls(table("pages"))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 3 = 1 THEN epoch_ms(date_trunc('second', ts)) WHEN event_id % 3 = 2 THEN epoch_us(ts) // 1000 ELSE epoch_ms(date_trunc('day', ts)) END AS parsed_ms FROM events""")
def p3_parse_times(spark, table):
    e = table("events")
    raw = F.when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 2, F.unix_millis("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", F.unix_millis("ts").alias("ms"), F.unix_millis(prepare.parse_times(raw)).alias("parsed_ms"))


@query(r"""WITH r AS (SELECT doc_id, source, nullif(trim(regexp_extract(text, '(?i)\b(?:version|ver|release)\s*v?\d+(?:\.\d+){0,3}(?:[-+_][0-9A-Za-z.-]+| (?:alpha|beta|rc|preview|pre|dev|nightly)\d*(?:[.-][0-9A-Za-z.-]+)?)?|\bv\d+(?:\.\d+){1,3}(?:[-+_][0-9A-Za-z.-]+)?', 0)), '') AS raw FROM documents),
  f AS (SELECT doc_id, source, raw, regexp_extract(raw, '(?i)(?:^|\b(?:version|ver|release)\s*)v?(\d+)(?:\.(\d+))?(?:\.(\d+))?', ['a','b','c']) AS p FROM r WHERE raw IS NOT NULL)
  SELECT doc_id, source, raw AS raw_version, p.a::BIGINT || '.' || (CASE WHEN p.b = '' THEN '0' ELSE p.b END)::BIGINT || '.' || (CASE WHEN p.c = '' THEN '0' ELSE p.c END)::BIGINT AS base_version FROM f""")
def p4_extract_versions(spark, table):
    d = table("documents").select("doc_id", "source", X.version_of(F.col("text")).alias("raw_version")).where("raw_version is not null")
    return d.withColumn("base_version", F.regexp_extract(X.normal_version(F.col("raw_version")), r"^(\d+\.\d+\.\d+)", 1))


@query("""SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, substr(sha256('["' || doc_id || '","' || source || '"]'), 1, 24) AS document_id FROM documents""")
def p5_hash_content(spark, table):
    return table("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.stable_id(F.col("doc_id"), F.col("source")).alias("document_id"))


@query(r"""WITH c AS (SELECT len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]')) AS zh, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents)
  SELECT CASE WHEN zh > 0 AND zh >= 0.15 * en THEN 'zh' WHEN en > 0 THEN 'en' ELSE 'und' END AS language, count(*) AS n FROM c GROUP BY 1""")
def p6_detect_language(spark, table):
    return table("documents").groupBy(X.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  k AS (SELECT *, nullif(lower(trim(line)), '') AS k FROM l),
  b AS (SELECT * FROM k WHERE k IS NULL OR NOT regexp_matches(k, '^(?:accept (?:all )?cookies?|cookie (?:settings|preferences|policy)|privacy preferences|skip to (?:main )?content|back to top)$')),
  p AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b)
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM p WHERE k IS NULL OR k IS DISTINCT FROM prev GROUP BY doc_id""")
def p7_collapse_lines(spark, table):
    return prepare.collapse_lines(table("documents"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  SELECT doc_id, pos, block FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(block) ORDER BY pos) AS n FROM l WHERE trim(block) <> '') WHERE n = 1""")
def p8_drop_repeat_blocks(spark, table):
    return prepare.drop_repeat_blocks(table("documents"))


def _plain(x):
    """Text of an element: no tags, five entities decoded, single blanks."""
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, z in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{z}')"
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


_TITLES = "SELECT page_id, coalesce(" + ", ".join(_plain(f"regexp_extract(html, '{p}', 1)") for p in (r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', "(?is)<h1[^>]*>(.*?)</h1>", "(?is)<title[^>]*>(.*?)</title>")) + ") AS title FROM pages"


@query(_TITLES)
def p10_page_title(spark, table):
    return html.page_metadata(table("pages")).select("page_id", "title")


@query(r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
  f AS (SELECT page_id, pos, origin, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:/]+:') || href WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS link FROM a WHERE NOT regexp_matches(lower(href), '^(#|mailto:|javascript:|tel:|data:)') AND href <> '')
  , q AS (SELECT page_id, pos, origin, array_to_string(list_transform(string_split(link, ''), lambda x: CASE WHEN regexp_matches(x, '[^A-Za-z0-9/%:@!$&''()*+,;=._~?-]') THEN url_encode(x) ELSE x END), '') AS link FROM f)
  SELECT page_id, min(pos) AS pos, link, bool_and(starts_with(link, origin)) AS same_origin FROM q GROUP BY page_id, link""")
def p14_page_links(spark, table):
    return html.page_links(table("pages")).select("page_id", "pos", "link", "same_origin")


@query(r"""WITH t AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages)
  SELECT page_id, n AS visible_chars, n < 200 AS needs_render FROM t""")
def p15_visible_text(spark, table):
    return prepare.visible_text(table("pages"))


@query("""SELECT code, known, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'EN-X' WHEN 'fr' THEN 'FR-X' ELSE lang END AS code, lang IN ('en', 'fr') AS known FROM documents) GROUP BY 1, 2""")
def p16_canonical_codes(spark, table):
    codes = spark.createDataFrame([("en", "EN-X"), ("fr", "FR-X")], "alias string, code string")
    return prepare.canonical_codes(table("documents").select("doc_id", "lang"), "lang", codes).groupBy("code", "known").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END END AS evidence_level FROM documents""")
def p17_evidence_level(spark, table):
    rows = [(f"src{i}", "ABCD"[i % 4]) for i in range(20)]
    d = table("documents").select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "A").when(F.col("doc_id") % 5 == 1, "Z").alias("own"))
    return prepare.evidence_level(d, "own", "source", spark.createDataFrame(rows, "source string, level string")).select("doc_id", "evidence_level")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02 changelog' || chr(10) || '# Title' || chr(10) || text ELSE 'intro' || chr(10) || '# Title' || chr(10) || text END AS t, text FROM documents)
  SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '# Title' || chr(10) || text ELSE t END) AS digest FROM d""")
def p19_strip_page_lead(spark, table):
    lead = F.when(F.col("doc_id") % 2 == 0, "2024-01-02 changelog").otherwise("intro")
    t = F.concat(lead, F.lit("\n# Title\n"), F.col("text"))
    return table("documents").select("doc_id", F.sha2(prepare.strip_page_lead(t), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'E1' WHEN CAST(substr(source, 4) AS INT) % 3 = 1 THEN 'E2' END AS event_type FROM documents""")
def l1_event_by_source(spark, table):
    rows = [(f"src{i}", "E1" if i % 3 == 0 else "E2") for i in range(20) if i % 3 < 2]
    return labels.event_by_source(table("documents"), "source", spark.createDataFrame(rows, "source string, event_type string")).select("doc_id", "event_type")


@query(_LABEL_SQL + "SELECT doc_id, array_to_string(tags, ',') AS tags, n_matches FROM c")
def l2_tag_dimensions(spark, table):
    return _labelled(table).select("doc_id", F.concat_ws(",", "dimension_tags").alias("tags"), "n_matches")


@query(_LABEL_SQL + "SELECT doc_id, round(conf, 6) AS confidence, len(tags) = 0 OR conf < 0.55 AS needs_review FROM c")
def l3_label_confidence(spark, table):
    return _labelled(table).select("doc_id", F.round("confidence", 6).alias("confidence"), "needs_review")


# reasons of the labels in c
_REASONS = "array_to_string(list_filter([CASE WHEN event_type IS NOT NULL THEN 'source->' || event_type END, " + ", ".join(f"CASE WHEN len(m_{d}) > 0 THEN '{d}:keywords=' || array_to_string(m_{d}[1:5], ',') END" for d in RULES) + "], lambda x: x IS NOT NULL), ';')"


@query(_LABEL_SQL + f"SELECT doc_id, {_REASONS} AS reasons FROM c")
def l4_label_evidence(spark, table):
    return _labelled(table).select("doc_id", "reasons")


@query("""WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(worthless|trash|disgusting)') THEN ['toxic'] ELSE [] END || CASE WHEN n_chars > 500 THEN ['good'] ELSE [] END AS a FROM documents),
  l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END || CASE WHEN quality = 1 THEN ['good'] ELSE [] END AS b FROM labels),
  j AS (SELECT coalesce(r.doc_id, l.doc_id) AS doc_id, coalesce(a, []) AS a, coalesce(b, []) AS b, r.doc_id IS NOT NULL AS ha, l.doc_id IS NOT NULL AS hb FROM r FULL OUTER JOIN l ON r.doc_id = l.doc_id),
  k AS (SELECT *, list_sort(a) = list_sort(b) AS agree, list_filter(a, lambda x: list_contains(b, x)) AS m FROM j)
  SELECT doc_id, array_to_string(m, ',') AS tags, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_first, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS only_second, agree,
    round(CASE WHEN agree THEN (CASE WHEN ha THEN 0.7 ELSE 0 END + CASE WHEN hb THEN 0.9 ELSE 0 END) / 2 ELSE 0.8 * least(CASE WHEN ha THEN 0.7 ELSE 0 END, CASE WHEN hb THEN 0.9 ELSE 0 END) END, 6) AS confidence,
    NOT agree OR len(m) = 0 AS needs_review FROM k""")
def l5_reconcile_labels(spark, table):
    pick = lambda c, v: F.when(c, F.lit(v))
    a = table("documents").select("doc_id", F.array_compact(F.array(pick(F.lower("text").rlike("(worthless|trash|disgusting)"), "toxic"), pick(F.col("n_chars") > 500, "good"))).alias("tags"), F.lit(0.7).alias("confidence"))
    b = table("labels").select("doc_id", F.array_compact(F.array(pick(F.col("toxic") == 1, "toxic"), pick(F.col("quality") == 1, "good"))).alias("tags"), F.lit(0.9).alias("confidence"))
    r = labels.reconcile(a, b)
    return r.select("doc_id", *[F.concat_ws(",", c).alias(c) for c in ("tags", "only_first", "only_second")], "agree", F.round("confidence", 6).alias("confidence"), "needs_review")


_HISTORY = """WITH o AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_no FROM o),
  v AS (SELECT user_id, version_no::BIGINT AS version_no, min(event_type) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_seen FROM g GROUP BY user_id, version_no),
  h AS (SELECT *, first_seen AS valid_from, lead(first_seen) OVER (PARTITION BY user_id ORDER BY version_no) AS valid_to FROM v) """


def history(table):
    return versions.version_history(table("events"), "user_id", "ts", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def v1_dedup_latest(spark, table):
    return versions.dedup_latest(table("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query(_HISTORY + "SELECT user_id, version_no, event_type, n_seen, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, valid_to IS NULL AS is_current FROM h")
def v2_version_history(spark, table):
    h = history(table)
    return h.select("user_id", "version_no", "event_type", "n_seen", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current")


@query("SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS raw_ids, arg_max(value, ts) AS newest FROM events GROUP BY 1, 2")
def v3_seen_metadata(spark, table):
    s = versions.seen_metadata(table("events"), "user_id", "event_type", "ts", "event_id", "value")
    return s.select("user_id", "event_type", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.concat_ws(",", F.transform("raw_ids", lambda x: x.cast("string"))).alias("raw_ids"), "newest")


def _split(table, cut=0.5):
    """Version tables from the first half of the observations and from all of them."""
    e = table("events")
    mid = e.agg(F.expr("percentile(event_id, 0.5)").alias("m"))
    old = versions.version_history(e.join(F.broadcast(mid), F.col("event_id") <= F.col("m")).drop("m"), "user_id", "ts", "event_type", "event_id")
    key = F.concat_ws("-", "user_id", "version_no").alias("version_id")
    return old.select("*", key), versions.version_history(e, "user_id", "ts", "event_type", "event_id").select("*", key)


_TWO = """WITH m AS (SELECT quantile_cont(event_id, 0.5) AS m FROM events),
  o AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_no FROM o),
  n AS (SELECT user_id || '-' || version_no::BIGINT AS version_id, user_id, min(ts) AS valid_from, version_no = max(version_no) OVER (PARTITION BY user_id) AS is_current FROM g GROUP BY user_id, version_no),
  o2 AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events, m WHERE event_id <= m.m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g2 AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_no FROM o2),
  f AS (SELECT user_id || '-' || version_no::BIGINT AS version_id, user_id, min(ts) AS valid_from, version_no = max(version_no) OVER (PARTITION BY user_id) AS is_current FROM g2 GROUP BY user_id, version_no) """


@query(_TWO + """SELECT count(*) FILTER (f.version_id IS NULL) AS added, count(*) FILTER (f.version_id IS NOT NULL AND n.version_id IS NOT NULL) AS unchanged,
  count(*) FILTER (f.is_current AND n.version_id IS NOT NULL AND NOT coalesce(n.is_current, false)) AS superseded FROM f FULL OUTER JOIN n USING (version_id)""")
def v4_merge_report(spark, table):
    return versions.merge_report(*_split(table))


@query(_TWO + """, a AS (SELECT * FROM f UNION ALL SELECT * FROM n WHERE version_id NOT IN (SELECT version_id FROM f))
  SELECT version_id, user_id, epoch_us(valid_from) AS from_us, epoch_us(lead(valid_from) OVER w) AS to_us, lead(valid_from) OVER w IS NULL AS is_current FROM a WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, version_id)""")
def v5_upsert_versions(spark, table):
    old, new = _split(table)
    u = versions.upsert_versions(old, new, "user_id")
    return u.select("version_id", "user_id", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current")


@query("""WITH e AS (SELECT user_id || '-' || event_type AS version_id, user_id, event_type = 'purchase' AS is_current FROM events)
  SELECT 'duplicate_version' AS kind, version_id AS id, count(*) AS n FROM e GROUP BY version_id HAVING count(*) > 1 UNION ALL SELECT 'many_current', user_id::VARCHAR, count(*) FROM e WHERE is_current GROUP BY user_id HAVING count(*) > 1""")
def v6_version_violations(spark, table):
    e = table("events").select(F.concat_ws("-", "user_id", "event_type").alias("version_id"), "user_id", (F.col("event_type") == "purchase").alias("is_current"))
    return versions.version_violations(e, "user_id")


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS scope, coalesce(lang, source) AS value, count(*) AS n, count(*) FILTER (n_chars < 200) AS short, count(*) FILTER (contains(text, '@')) AS mail
  FROM documents GROUP BY GROUPING SETS ((), (lang), (source))""")
def v7_corpus_stats(spark, table):
    return versions.corpus_stats(table("documents"), ["lang", "source"], {"short": F.col("n_chars") < 200, "mail": F.col("text").contains("@")})


@query(_HISTORY + ", c AS (SELECT user_id, version_no, valid_from, CASE WHEN version_no % 7 = 3 THEN NULL WHEN version_no % 7 = 5 THEN valid_to + INTERVAL 1 HOUR ELSE valid_to END AS valid_to, CASE WHEN version_no % 7 = 3 THEN true ELSE valid_to IS NULL END AS is_current FROM h), "
 "x AS (SELECT *, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, valid_to NULLS LAST) AS nxt FROM c) "
 "SELECT DISTINCT user_id, 'overlap' AS finding FROM x WHERE nxt < valid_to UNION SELECT DISTINCT user_id, 'open_inner' FROM x WHERE nxt IS NOT NULL AND valid_to IS NULL UNION SELECT user_id, 'current_count' FROM c GROUP BY user_id HAVING count(*) FILTER (is_current) <> 1")
def a5_interval_checks(spark, table):
    h, k = history(table), F.col("version_no") % 7
    h = h.withColumn("is_current", F.when(k == 3, True).otherwise(F.col("valid_to").isNull())).withColumn("valid_to", F.when(k == 3, F.lit(None).cast("timestamp")).when(k == 5, F.col("valid_to") + F.expr("interval 1 hour")).otherwise(F.col("valid_to")))
    return versions.interval_checks(h, "user_id")


@query(_HISTORY + "SELECT user_id, event_type, version_no FROM h WHERE valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')")
def f3_as_of(spark, table):
    return versions.as_of(history(table), F.lit("2024-01-10").cast("timestamp")).select("user_id", "event_type", "version_no")


@query(_HISTORY + """, p AS (SELECT event_id, user_id, ts + INTERVAL 5 HOUR AS at FROM events UNION ALL SELECT event_id, user_id, ts - INTERVAL 5 HOUR FROM events)
  SELECT p.event_id, epoch_us(p.at) AS at_us, h.version_no, h.event_type FROM p LEFT JOIN h ON h.user_id = p.user_id AND h.valid_from <= p.at AND (h.valid_to IS NULL OR h.valid_to > p.at)""")
def f3_as_of_join(spark, table):
    e = table("events").select("event_id", "user_id", F.explode(F.array(F.col("ts") + F.expr("interval 5 hours"), F.col("ts") - F.expr("interval 5 hours"))).alias("at"))
    j = versions.as_of_join(e, history(table), "user_id", "at", ["version_no", "event_type"])
    return j.select("event_id", F.unix_micros("at").alias("at_us"), "version_no", "event_type")
