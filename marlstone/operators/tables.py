"""Filters, audits, chunks, index maintenance and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords
from ..sources import published

# fixed values: what noise and sensitive content look like
NOISE = {
    "html_artifact": r"(?i)<\s*/?\s*(?:script|style|nav|footer|header|button|input|select|option)\b",
    "cookie_banner": r"(?i)\b(?:accept all cookies|manage cookie preferences|cookie settings)\b",
    "navigation": r"(?i)(?:^|\n)\s*(?:skip to content|back to top)\s*(?:\n|$)",
}
SENSITIVE = {
    "email": r"(?i)(?:^|[^\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "phone": r"(?:^|[^\w+])\+\d(?:[ ()-]*\d){7,14}(?:[^\d]|$)|(?:^|\D)(?:\(\d{2,4}\)|\d{2,4})[ -]\d{3,4}[ -]\d{3,4}(?:\D|$)",
    "long_number": r"(?:^|\D)\d{12,}(?:\D|$)",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})\b",
    "user_path": r"(?i)\b[A-Z]:\\(?:Users|Documents and Settings)\\[^\s\\]+",
}


def flags(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def route_records(df: DataFrame, status: Column, error: Column, payload: Column, index_row: Column) -> DataFrame:
    """Adds `route`: skip, acquisition_failure, missing_payload or process."""
    r = F.when(index_row | (status == 304), "skip").when(error | (status >= 400), "acquisition_failure").when(~payload, "missing_payload").otherwise("process")
    return df.withColumn("route", r)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows with the total count and number of pages."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def infer_filters(questions: DataFrame, id_col: str, text: str, aliases: DataFrame, kinds: dict[str, list[str]], explicit: DataFrame | None = None) -> DataFrame:
    """id, kinds, versions, days, current, competitor from question text: the longest alias, keyword kinds, version literals, a relative window, a wish for the current state.

    aliases: alias, canonical.  explicit: id, competitor, days, current as they were asked
    for; what is stated there wins.
    """
    low = F.lower(F.col(text))
    named = keywords.occurring(questions, id_col, low, aliases, "alias").join(aliases.select(F.lower("alias").alias("term"), "canonical"), "term")
    best = named.groupBy(id_col).agg(F.max_by("canonical", F.struct(F.length("term"), "canonical")).alias("competitor"))
    now = ("latest", "current", "currently", "newest", "最新", "当前", "目前")
    words = sorted({w for ws in kinds.values() for w in ws} | set(now))
    q = questions.select(id_col, low.alias("_t"), keywords.occurrences(low, words).alias("_hits"))
    found = F.transform("_hits", lambda x: x["term"])
    any_of = lambda ws: F.arrays_overlap(found, F.array(*[F.lit(w) for w in ws]))
    kind = F.array_compact(F.array(*[F.when(any_of(ws), F.lit(k)) for k, ws in kinds.items()]))
    rel = r"(?:last|past)\s*(\d+)\s*(day|week|month|year)s?"
    n, unit = F.regexp_extract("_t", rel, 1), F.regexp_extract("_t", rel, 2)
    days = n.try_cast("int") * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    versions = F.regexp_extract_all("_t", F.lit(r"\bv?(\d+(?:\.\d+){1,3})\b"), 1)
    out = q.select(id_col, kind.alias("kinds"), versions.alias("versions"), days.alias("days"), any_of(now).alias("current")).join(best, id_col, "left")
    if explicit is not None:
        e = explicit.select(F.col(id_col).alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("competitor", "days", "current")])
        out = out.join(e, F.col(id_col) == F.col("_i"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("competitor", "days", "current")}).drop("_i", "_competitor", "_days", "_current")
    return out


def expand_queries(questions: DataFrame, id_col: str, text: str, synonyms: DataFrame) -> DataFrame:
    """Synonyms (term, synonym, seq) of terms in the question that it lacks, appended in order."""
    q = questions.select(id_col, F.col(text).alias("_t"))
    s = synonyms.select(F.lower("term").alias("term"), "synonym", "seq")
    both = s.select("term").unionByName(s.select(F.lower("synonym").alias("term")))
    held = keywords.occurring(q, id_col, F.lower("_t"), both, "term").select(id_col, "term")
    add = held.join(s, "term").groupBy(id_col, "synonym").agg(F.min("seq").alias("seq"))
    add = add.join(held.withColumnRenamed("term", "_k"), [add[id_col] == held[id_col], F.lower("synonym") == F.col("_k")], "left_anti")
    add = add.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "synonym"))).alias("_s"))
    j = q.join(add, id_col, "left")
    extra = F.array_join(F.transform("_s", lambda x: x["synonym"]), " ")
    return j.select(id_col, F.concat_ws(" ", "_t", extra).alias("expanded"), F.coalesce(F.size("_s"), F.lit(0)).alias("n_added"))


def repeated_lines(docs: DataFrame, least_chars: int = 20, times: int = 3) -> DataFrame:
    """doc_id of documents with a line of at least 20 characters that occurs three times."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line") >= least_chars)
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= times).select("doc_id").distinct()


# fixed values: what is blanked out of a log line, in order, and by what
REDACTIONS = (
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"(?i)\b(api[_ -]?key|authorization|bearer|token|secret)\b\s*[:=]?\s*[^\s,;]+", "$1=[REDACTED]"),
    (r"(?is)\bprompt\b\s*[:=].*$", "prompt=[REDACTED]"),
)


def redact(c: Column, most: int = 1000) -> Column:
    """Blanks collapsed, key-like tokens and values after credential words replaced, cut at a prompt marker."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.substring(reduce(lambda x, r: F.regexp_replace(x, *r), REDACTIONS, t), 1, most)


def decide(findings: DataFrame, docs: DataFrame, severity: dict[str, str]) -> DataFrame:
    """FAIL if any finding fails, else NEEDS_REVIEW if there is any, else PASS: doc_id, decision, findings."""
    g = findings.select("doc_id", "finding").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    fails = F.array(*[F.lit(k) for k, v in severity.items() if v == "fail"])
    j = docs.select("doc_id").join(g, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
    return j.withColumn("decision", F.when(F.arrays_overlap("findings", fails), "FAIL").when(F.size("findings") > 0, "NEEDS_REVIEW").otherwise("PASS"))


def fixed_chunks(docs: DataFrame, size: int = 1200, stride: int = 1040, least: int = 80) -> DataFrame:
    """Fixed-stride windows that are exact slices: doc_id, chunk_index, char_start, char_end, content."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    c = docs.where("text is not null and text <> ''").select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "char_start"))
    c = c.withColumn("content", F.expr(f"substring(text, char_start + 1, {size})"))
    c = c.withColumn("char_end", F.col("char_start") + F.length("content")).where((F.col("chunk_index") == 0) | (F.length("content") >= least))
    return c.select("doc_id", "chunk_index", "char_start", "char_end", "content", F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), "content"), 256), 1, 24).alias("chunk_id"))


def chunk_integrity(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings of chunks whose text is not the slice it claims, of empty ones and of repeated ids."""
    j = chunks.join(docs.select("doc_id", "text"), "doc_id", "left")
    slice_ = F.expr("substring(text, char_start + 1, char_end - char_start)")
    one = lambda cond, name: j.where(cond).select("chunk_id", F.lit(name).alias("finding"))
    dup = chunks.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select("chunk_id", F.lit("duplicate_id").alias("finding"))
    return reduce(DataFrame.unionByName, [one(F.col("text").isNull(), "no_document"), one(F.col("text").isNotNull() & (slice_ != F.col("content")), "slice_mismatch"), one(F.length("content") != F.col("char_end") - F.col("char_start"), "length_mismatch"), one(F.col("content") == "", "empty"), dup])


def sync_index(current: DataFrame, incoming: DataFrame, key: str, text: str, meta: list[str]) -> DataFrame:
    """key, action: unchanged, metadata (text equal), reembed, add or delete."""
    a = current.select(F.col(key).alias("_a"), F.xxhash64(text).alias("_at"), F.xxhash64(*meta).alias("_am"))
    b = incoming.select(F.col(key).alias("_b"), F.xxhash64(text).alias("_bt"), F.xxhash64(*meta).alias("_bm"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    act = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").when(F.col("_at") != F.col("_bt"), "reembed").when(F.col("_am") != F.col("_bm"), "metadata").otherwise("unchanged")
    return j.select(F.coalesce("_a", "_b").alias(key), act.alias("action"))


def embed_distinct(docs: DataFrame, id_col: str, text: str, embed) -> DataFrame:
    """Equal texts embedded once: embed maps a frame (text_hash, text) to (text_hash, ...); fanned out to all ids."""
    d = docs.withColumn("text_hash", F.sha2(F.col(text), 256))
    one = embed(d.select("text_hash", F.col(text).alias("text")).dropDuplicates(["text_hash"]))
    return d.select(id_col, "text_hash").join(one, "text_hash")


def publish_index(index: DataFrame, root: str, version: str, clean: bool, **checks) -> bool:
    """Makes a build of an index current (see published.publish); one that is not clean is not written."""
    if not clean:
        return False
    published.publish(index, root, version, **checks)
    return True


def reference_checks(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows of child whose key is not in parent: check, key, n."""
    miss = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    return miss.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "key", "n")


def evidence_index(cards: DataFrame, evidence: DataFrame, card: str, chunk: str, order: list[Column], title: str, meta: list[str]) -> DataFrame:
    """One row for each chunk: its first card by `order`, the number of titles, and whether its metadata disagree."""
    j = evidence.join(cards, card)
    w = Window.partitionBy(chunk).orderBy(*order)
    top = j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(chunk, F.col(card).alias("card"))
    g = j.groupBy(chunk).agg(F.countDistinct(title).alias("n_titles"), (F.countDistinct(F.struct(*meta)) > 1).alias("disagrees"), F.countDistinct(card).alias("n_cards"))
    return top.join(g, chunk)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
