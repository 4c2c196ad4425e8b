"""Sources and sinks over files, with Spark's readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import published

CAPTURE = "schema_version string, raw_record_id string, crawl_run_id string, competitor string, source_type string, requested_url string, canonical_url string, final_url string, fetched_at timestamp, published_at timestamp, http_status int, content_type string, etag string, last_modified string, payload_path string, payload_hash string, error string, needs_browser boolean, source_metadata string, _bad string"
DOCUMENT = "document_id string, version_id string, raw_record_id string, raw_path string, competitor string, title string, content string, source_type string, evidence_level string, url string, raw_version string, product_version string, publish_time timestamp, crawl_time timestamp, event_type string, dimension_tags array<string>, content_hash string, is_current boolean, valid_from timestamp, valid_to timestamp, index_status string, language string, author string, source_metadata string, label_confidence double, label_reasons array<string>, needs_review boolean, _bad string"
# fixed values: the columns of a runs file in their order, those that prove a run's origin, and those that are read as flags and numbers
RUN_COLUMNS = (
    "run_id", "competitor", "task_id", "task_revision", "task_fingerprint", "validator_sha256", "protocol_sha256", "starter_sha256", "candidate_sha256", "product_version", "model",
    "task_success", "compile_success", "test_pass_rate", "edit_rounds", "latency_ms", "manual_intervention", "estimated_cost", "harmful_action", "notes", "run_at",
)
PROVENANCE = ("task_fingerprint", "validator_sha256", "protocol_sha256", "starter_sha256", "candidate_sha256")
RUN_KINDS = {"task_success": "flag", "compile_success": "flag", "harmful_action": "flag", "test_pass_rate": "double", "estimated_cost": "double", "edit_rounds": "int", "latency_ms": "int", "manual_intervention": "int", "run_at": "timestamp"}
RUN_DEFAULTS = {"task_success": False, "harmful_action": False, "test_pass_rate": 0.0, "edit_rounds": 0, "latency_ms": 0, "manual_intervention": 0, "estimated_cost": 0.0}


def _uri(c: Column) -> Column:
    """A file's address with one slash after the scheme, as readers differ in that."""
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """Captures from *.meta.json anywhere below root joined to their payloads: capture columns, meta_path, payload, failure.

    A payload path is absolute, or lies below root, or else beside its sidecar; the whole
    address must agree, so that equal file names of different runs stay apart.
    """
    meta = spark.read.schema(CAPTURE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(root)
    meta = meta.withColumn("meta_path", F.input_file_name())
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    folder, scheme = F.regexp_replace("meta_path", r"/[^/]*$", ""), base.split(":", 1)[0]
    at = F.col("payload_path")
    places = F.when(at.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/"), F.array(at)).when(at.startswith("/"), F.array(F.concat(F.lit(scheme + ":"), at))).otherwise(F.array(F.concat(F.lit(base + "/"), at), F.concat(folder, F.lit("/"), at)))
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").endswith(".meta.json")).select(_uri(F.col("path")).alias("_place"), F.col("content").alias("payload"))
    want = meta.where("payload_path is not null").select("meta_path", F.posexplode(F.transform(places, _uri)).alias("_n", "_place"))
    found = want.join(data.select("_place"), "_place").groupBy(F.col("meta_path").alias("_m")).agg(F.min(F.struct("_n", "_place"))["_place"].alias("_place"))
    j = meta.join(found, F.col("meta_path") == F.col("_m"), "left").join(data, "_place", "left").drop("_place", "_m")
    digest = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    why = F.when(F.col("_bad").isNotNull(), "invalid_json").when(F.col("payload_path").isNotNull() & F.col("payload").isNull(), "missing_payload").when(F.col("payload").isNotNull() & F.col("payload_hash").isNotNull() & (digest != F.col("payload_hash")), "hash_mismatch")
    return j.withColumn("failure", why).drop("_bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of text files, however their splits lie.

    A split's lines are counted as they are read; the counts of the splits before it in
    its file (one small row for each split) give its first number.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))

    def count(batches):
        seen: dict[tuple, int] = {}  # the splits of one task
        for b in batches:
            n = []
            for key in zip(b["file"], b["_at"]):
                seen[key] = seen.get(key, 0) + 1
                n.append(seen[key])
            b["_n"] = n
            yield b

    own = raw.mapInPandas(count, "value string, file string, _at long, _n long")
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = own.groupBy(F.col("file").alias("_f"), F.col("_at").alias("_s")).agg(F.max("_n").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    j = own.join(per.drop("_k"), (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_s")))
    return j.select("file", (F.col("_before") + F.col("_n")).alias("line"), "value")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid document versions, and rejects (file, line, reason, raw); blank lines are skipped.

    Bad rows, repeated version ids and second current versions are rejects.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.withColumn("_d", F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).select("file", "line", "value", "_d.*")
    why = F.when(F.col("_bad").isNotNull(), "invalid_json").when(F.col("version_id").isNull(), "missing_id")
    n = F.count("*").over(Window.partitionBy("version_id"))
    cur = F.count_if("is_current").over(Window.partitionBy("document_id"))
    bad = rows.withColumn("reason", why).where("reason is not null").select("file", "line", "reason", F.col("value").alias("raw"))
    good = rows.where(why.isNull()).withColumns({"_n": n, "_c": cur})
    clash = F.when(F.col("_n") > 1, "duplicate_version").when(F.col("is_current") & (F.col("_c") > 1), "many_current")
    good = good.withColumn("reason", clash)
    ok = good.where("reason is null").drop("_bad", "_n", "_c", "file", "line", "value", "reason")
    return ok, bad.unionByName(good.where("reason is not null").select("file", "line", "reason", F.col("value").alias("raw")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries: title, link, body, author, published."""
    item = "guid string, title string, link string, pubDate string, author string, description string, encoded string"
    entry = "id string, title string, link struct<_href:string>, updated string, published string, author struct<name:string>, summary string, content string"
    rss = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(item).load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(entry).load(path)
    a = rss.select("title", F.coalesce("link", "guid").alias("link"), F.coalesce("encoded", "description").alias("body"), "author", F.col("pubDate").alias("published"))
    b = atom.select("title", F.coalesce("link._href", "id").alias("link"), F.coalesce("content", "summary").alias("body"), F.col("author.name").alias("author"), F.coalesce("published", "updated").alias("published"))
    return a.unionByName(b).where("title is not null or link is not null")


ISSUE = "array<struct<id:bigint,number:bigint,title:string,html_url:string,body:string,state:string,user:struct<login:string>,labels:array<struct<name:string>>,comments:int,comment_items:array<struct<id:bigint,body:string,user:struct<login:string>,created_at:timestamp>>,created_at:timestamp,updated_at:timestamp,pull_request:struct<url:string>>>"


def read_repo_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Issues (pull requests left out, with comments_truncated) and their comments from JSON files of issue lists."""
    raw = spark.read.option("wholetext", "true").text(path)
    i = raw.select(F.explode(F.from_json("value", ISSUE)).alias("i")).select("i.*").where("pull_request is null")
    issues = i.select("id", "number", "title", "html_url", "body", "state", F.col("user.login").alias("author"), F.transform("labels", lambda x: x["name"]).alias("labels"), (F.coalesce("comments", F.lit(0)) > F.coalesce(F.size("comment_items"), F.lit(0))).alias("comments_truncated"), "created_at", "updated_at")
    comments = i.select("number", F.explode_outer("comment_items").alias("c")).where("c is not null").select("number", "c.id", "c.body", F.col("c.user.login").alias("author"), "c.created_at")
    return issues, comments


def releases(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """Releases from the cutoff on: tag, name, body, author, published_at."""
    kind = "array<struct<id:bigint,tag_name:string,name:string,body:string,html_url:string,draft:boolean,prerelease:boolean,author:struct<login:string>,published_at:timestamp,created_at:timestamp>>"
    r = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", kind)).alias("r")).select("r.*")
    return r.withColumn("published_at", F.coalesce("published_at", "created_at")).where(F.col("published_at") >= F.lit(cutoff).cast("timestamp")).select("id", "tag_name", "name", "body", "html_url", F.col("author.login").alias("author"), "published_at")


def read_json_documents(df: DataFrame, column: str, config: dict[str, str | list[str]]) -> DataFrame:
    """Documents from JSON text: dotted paths for title, time, author and content (one or several, concatenated); empty content drops a row."""
    v = F.try_parse_json(column)
    get = lambda p: F.try_variant_get(v, "$." + p, "string")
    paths = config["content"] if isinstance(config["content"], list) else [config["content"]]
    out = df.select("*", *[get(config[k]).alias(k) for k in ("title", "time", "author") if k in config], F.concat_ws("\n", *[get(p) for p in paths]).alias("content"))
    return out.where(F.trim("content") != "")


def list_field(c: Column) -> Column:
    """A JSON array or text split at the first of ; | , that occurs; blank is null."""
    t = F.trim(c)
    split = F.when(t.contains(";"), F.split(t, ";")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.split(t, ","))
    parts = F.filter(F.transform(F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(split), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t != "", parts)


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from CSV; list fields in JSON or delimited form, map fields in JSON, blanks missing."""
    c = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    out = c.withColumns({k: list_field(F.col(k)) for k in ("relevant_document_ids", "relevant_chunk_ids", "expected_dimension_tags") if k in c.columns})
    out = out.withColumns({k: F.from_json(blank(F.col(k)), "map<string,double>") for k in ("relevance_grades",) if k in c.columns})
    return out.withColumns({k: blank(F.col(k)) for k in ("expected_competitor", "expected_event_type", "expected_version", "expected_evidence_quote") if k in c.columns})


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and rejects (with `reject`) from CSV whose header must equal the contract, in order.

    A row is rejected for itself: without a hash that proves its origin, without a
    competitor, task or revision, with a flag or number that is none, out of its range, or
    below 0.  Blank values take their defaults, else they are null; extra values reject.
    """
    header = tuple(x.strip() for x in spark.read.option("header", "true").csv(path).columns)
    if header != RUN_COLUMNS:
        lacks, more = [x for x in RUN_COLUMNS if x not in header], [x for x in header if x not in RUN_COLUMNS]
        raise ValueError(f"header is not the contract's: missing {lacks}, unknown {more}, order {list(RUN_COLUMNS)}")
    r = spark.read.schema(", ".join(f"{c} string" for c in (*RUN_COLUMNS, "_more"))).option("header", "true").option("multiLine", "true").option("escape", '"').option("enforceSchema", "true").csv(path)
    text = {c: F.nullif(F.trim(c), F.lit("")) for c in (*RUN_COLUMNS, "_more")}
    yes = lambda c: F.when(F.lower(c).isin("true", "1", "yes", "y"), True).when(F.lower(c).isin("false", "0", "no", "n"), False)
    read = {c: yes(text[c]) if k == "flag" else text[c].try_cast(k) for c, k in RUN_KINDS.items()}
    why = F.when(reduce(lambda a, b: a | b, [text[c].isNull() for c in PROVENANCE]), "missing_provenance")
    why = why.when(text["_more"].isNotNull(), "extra_values")
    for c in ("competitor", "task_id", "task_revision"):
        why = why.when(text[c].isNull(), f"missing_{c}")
    for c, v in read.items():
        why = why.when(text[c].isNotNull() & v.isNull(), f"bad_{c}")
    for c in ("test_pass_rate", "estimated_cost", "edit_rounds", "latency_ms", "manual_intervention"):
        why = why.when((read[c] < 0) | (read[c] > 1 if c == "test_pass_rate" else F.lit(False)) | (F.isnan(read[c]) if RUN_KINDS[c] == "double" else F.lit(False)), f"bad_{c}")
    out = [F.coalesce(read[c], F.lit(RUN_DEFAULTS[c])).alias(c) if c in RUN_DEFAULTS else read.get(c, text[c]).alias(c) for c in RUN_COLUMNS]
    t = r.select(*out, why.alias("reject"))
    return t.where("reject is null").drop("reject"), t.where("reject is not null")


def read_config_table(spark: SparkSession, mapping: dict[str, list[str]], key: str, value: str) -> DataFrame:
    """Code table (key, value, seq) from a parsed configuration; small enough to broadcast."""
    rows = [(k, v, i) for k, vs in mapping.items() for i, v in enumerate(vs)]
    return F.broadcast(spark.createDataFrame(rows, f"{key} string, {value} string, seq int"))


def write_versioned(df: DataFrame, root: str, version: str, failures: DataFrame | None = None, **checks) -> bool:
    """Publishes a new version of a derived table (see published.publish); with any failure the old output stays."""
    if failures is not None and not failures.isEmpty():
        return False
    published.publish(df, root, version, **checks)
    return True


def write_raw(df: DataFrame, path: str) -> None:
    """Content-addressed captures partitioned by competitor, source type and run; rows without payload are kept."""
    rid = F.sha2(F.concat_ws("\0", "competitor", "source_type", "requested_url", F.coalesce("payload_hash", F.lit("")), F.col("fetched_at").cast("string")), 256)
    df.withColumn("raw_record_id", rid).write.mode("append").partitionBy("competitor", "source_type", "crawl_run_id").parquet(path)


def write_review_queue(audit: DataFrame, path: str) -> None:
    """Rows that did not pass, as CSV with the findings as JSON."""
    audit.where("decision <> 'PASS'").withColumn("findings", F.to_json("findings")).write.mode("overwrite").option("header", "true").csv(path)


def import_bundle(spark: SparkSession, manifest: dict[str, int], tables: dict[str, DataFrame], digest: str, log: DataFrame) -> DataFrame:
    """table, expected, found, ok; a bundle whose digest the log holds gives no rows (it was imported before)."""
    rows = spark.createDataFrame([(k, v, digest) for k, v in manifest.items()], "table string, expected long, digest string").join(log.select("digest"), "digest", "left_anti")
    found = None
    for k, df in tables.items():
        one = df.agg(F.count("*").alias("found")).withColumn("table", F.lit(k))
        found = one if found is None else found.unionByName(one)
    return rows.join(found, "table", "left").select("table", "expected", F.coalesce("found", F.lit(0)).alias("found")).withColumn("ok", F.col("expected") == F.col("found"))


def append_trace(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
