"""Quotes, citations, facts, conflicts and extractive answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import written
from .retrieval import lexical_score, settle


def select_quotes(candidates: DataFrame, query: str, id_col: str, question: str, text: str, most: int = 400) -> DataFrame:
    """Best line of each candidate by lexical relevance, the first of equal ones, cut to `most` characters."""
    seg = candidates.select(query, id_col, question, F.posexplode(F.split(text, "\n")).alias("pos", "seg")).where(F.trim("seg") != "")
    seg = seg.withColumn("_s", settle(lexical_score(F.col(question), F.col("seg"))))
    best = seg.groupBy(query, id_col).agg(F.max_by("seg", F.struct("_s", -F.col("pos"))).alias("quote"), F.max("_s").alias("quote_score"))
    return best.withColumn("quote", F.substring("quote", 1, most))


def build_evidence(ranked: DataFrame, query: str, chunk: str, k: int) -> DataFrame:
    """First occurrence of each chunk in rank order, the first k, with a stable citation id."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(query, chunk).orderBy("rank"))).where("_n = 1").drop("_n")
    e = first.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("rank", chunk))).where(F.col("position") <= k)
    return e.withColumn("citation_id", F.substring(F.sha2(F.concat_ws("|", F.col(query).cast("string"), F.col(chunk).cast("string")), 256), 1, 16))


def plain(c: Column) -> Column:
    """Entities resolved, blanks collapsed, case folded (of equal upper case, a final sigma as any): what quotes and fields are compared by."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    # the blanks' pattern stands between upper and lower, which Spark takes for lower alone where they meet
    return F.translate(F.lower(F.trim(F.regexp_replace(F.upper(c), r"[\s\u00a0]+", " "))), "ς", "σ")


def _address(c: Column) -> Column:
    """A web address without fragment and last slash, scheme and host in lower case; null if it is none."""
    c = F.trim(c)
    form = r"^((?i:https?)://[^/?#]+)([^?#]*)(\?[^#]*)?"
    return F.when(c.rlike(form), F.concat(F.lower(F.regexp_extract(c, form, 1)), F.regexp_replace(F.regexp_extract(c, form, 2), r"/+$", ""), F.regexp_extract(c, form, 3)))


SAME = ("document_id", "version_id", "title", "product_version", "competitor")


def validate_citations(citations: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """citations with `findings` and `warnings`, arrays of codes, each rule over the columns that both sides have.

    citations: query, chunk_id, quote.  evidence: query, chunk_id, text.  Findings:
    unknown_chunk; out_of_scope (known to other queries only); quote_absent (neither the
    quote nor, in order, its two or more parts between ellipses); of columns in both,
    where the citation states one: url_invalid (either side's), url_mismatch, and
    <column>_mismatch for SAME, char_start, char_end and publish_time.  Warnings: no_quote,
    and weak_level for evidence_level C or D.  An unknown chunk has no other finding.
    """
    c = F.col
    shared = [x for x in ("url", *SAME, "char_start", "char_end", "publish_time") if x in citations.columns and x in evidence.columns]
    more = [*shared, *[x for x in ("evidence_level",) if x in evidence.columns]]
    known = evidence.select(c("chunk_id").alias("_c"), c("text").alias("_t"), *[c(x).alias(f"_e_{x}") for x in more]).dropDuplicates(["_c"])
    scope = evidence.select(c(query).alias("_q"), c("chunk_id").alias("_s")).distinct()
    j = citations.join(known, c("chunk_id") == c("_c"), "left").join(scope, (c(query) == c("_q")) & (c("chunk_id") == c("_s")), "left")
    have, quote, text = c("_c").isNotNull(), plain(c("quote")), plain(c("_t"))
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…+"), lambda p: F.trim(p)), lambda p: p != "")
    # after each part only what follows it is searched for the next
    rest = F.aggregate(parts, text, lambda a, p: F.when(a.contains(p), F.substring(a, F.position(p, a) + F.length(p), F.length(a))))
    present = text.contains(quote) | ((F.size(parts) > 1) & rest.isNotNull())
    rules = [F.when(~have, "unknown_chunk"), F.when(have & c("_s").isNull(), "out_of_scope"), F.when(have & (quote != "") & ~present, "quote_absent")]
    for x in shared:
        stated, kept = c(x), c(f"_e_{x}")
        if x == "url":
            bad = _address(kept).isNull() | ((F.coalesce(stated, F.lit("")) != "") & _address(stated).isNull())
            rules.append(F.when(have & bad, "url_invalid").when(have & (_address(stated) != _address(kept)), "url_mismatch"))
        elif x in SAME:
            rules.append(F.when(have & (plain(stated) != "") & (plain(stated) != plain(kept)), f"{x}_mismatch"))
        else:
            rules.append(F.when(have & stated.isNotNull() & ~stated.eqNullSafe(kept), f"{x}_mismatch"))
    warn = [F.when(have & (quote == ""), "no_quote")]
    if "evidence_level" in more:
        warn.append(F.when(F.upper("_e_evidence_level").isin("C", "D"), "weak_level"))
    return j.withColumns({"findings": F.array_compact(F.array(*rules)), "warnings": F.array_compact(F.array(*warn))}).drop("_c", "_t", "_q", "_s", *[f"_e_{x}" for x in more])


def extract_facts(chunks: DataFrame, id_col: str, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row for each non-null field of a chunk: id, kept columns, field, value; unique per chunk."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return chunks.select(id_col, *keep, F.explode(pairs).alias("_p")).select(id_col, *keep, "_p.field", "_p.value").where("value is not null").dropDuplicates([id_col, "field", "value"])


PRICES = ("price_value", "currency", "billing_period")


def stated_facts(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """id, entity, field, value of all that a chunk states, one row for each unlike value; columns that chunks lack count as null.

    facts (an array of field, value, entity): each one.  fact_field, fact_value: one more.
    source_type pricing with a plan_name: PRICES, of the plan.  repository, github_number,
    github_state: the state, of `repository#number`.  Without an own one the entity is
    fact_entity, entity, plan_name or `default`.  Nulls and empty values state nothing;
    case and blanks make no difference, the first of equal ones (in binary order) stays.
    """
    c = lambda x: F.col(x) if x in chunks.columns else F.lit(None).cast("string")
    known = lambda x: F.nullif(c(x).cast("string"), F.lit(""))
    entity = F.coalesce(known("fact_entity"), known("entity"), known("plan_name"), F.lit("default"))
    fact = lambda when, field, value, of: F.when(when, F.struct(field.cast("string").alias("field"), value.cast("string").alias("value"), of.cast("string").alias("entity")))
    yes = F.lit(True)
    found = F.array(
        fact(c("fact_field").isNotNull(), c("fact_field"), c("fact_value"), entity),
        *[fact((c("source_type") == "pricing") & known("plan_name").isNotNull(), F.lit(x), c(x), c("plan_name")) for x in PRICES],
        fact(known("repository").isNotNull() & c("github_number").isNotNull(), F.lit("github_state"), c("github_state"), F.concat_ws("#", c("repository"), c("github_number"))),
    )
    if "facts" in chunks.columns:
        found = F.concat(F.transform(F.coalesce("facts", F.array().cast(chunks.schema["facts"].dataType)), lambda x: fact(yes, x["field"], x["value"], F.coalesce(F.nullif(x["entity"], F.lit("")), entity))), found)
    f = chunks.where(F.col(id_col).isNotNull()).select(id_col, F.explode(F.array_compact(found)).alias("_f")).select(id_col, "_f.*").where("field <> '' and value <> ''")
    return f.groupBy(id_col, F.lower("field").alias("_l"), F.lower("entity").alias("_m"), plain(F.col("value")).alias("_v")).agg(F.min(F.struct("value", "field", "entity")).alias("_f")).select(id_col, "_f.entity", "_f.field", "_f.value")


FACTS_A_TASK = 100_000  # facts that one task counts, about
LEVELS = {"A": 4, "B": 3, "C": 2, "D": 1}  # fixed values: authority of evidence levels


def preference(columns: list[str], chunk: str) -> list[Column]:
    """What makes a fact preferred, first to last: current, authority, publish time, score, chunk id; as far as the table has them."""
    level = reduce(lambda w, kv: w.when(F.upper("evidence_level") == kv[0], F.lit(kv[1])), LEVELS.items(), F.when(F.lit(False), F.lit(0))).otherwise(0) if "evidence_level" in columns else None
    known = {"is_current": F.coalesce("is_current", F.lit(True)), "evidence_level": level, "publish_time": F.col("publish_time"), "final_score": F.coalesce("final_score", F.lit(0.0)), chunk: F.col(chunk)}
    return [v for k, v in known.items() if k in columns]


def detect_conflicts(facts: DataFrame, group: list[str], chunk: str, start: str = "valid_from", end: str = "valid_to", order: list[Column] | None = None) -> DataFrame:
    """One row for each group with unlike values valid at the same time: values, chunks, n_pairs, preferred.

    Groups and values are compared without regard to case and blanks and shown as they
    first stand (least text).  Intervals are half-open, so adjacent ones do not conflict; a
    null start or end is open; a chunk that states a value twice counts once for each
    interval, and never conflicts with itself.  Nothing is joined pair by pair: at an
    interval's end the starts before it are counted, at its start the ends up to it, once
    for all of the group and once for its own value; the difference is its conflicting
    partners.  The preferred chunk is the first by `order`, else by preference() where the
    table has its columns, else by an open end and the latest start.
    """
    c = F.col
    shown = facts.withColumns({f"_k{i}": plain(c(g).cast("string")) for i, g in enumerate(group)} | {"_v": plain(c("value"))})
    keys = [f"_k{i}" for i in range(len(group))]
    known = [x for x in ("is_current", "evidence_level", "publish_time", "final_score") if x in facts.columns]
    # a chunk's equal statements over one interval count once
    f = shown.groupBy(*keys, "_v", chunk, c(start).alias("_a"), c(end).alias("_z")).agg(F.min("value").alias("value"), F.min(F.struct(*group)).alias("_g"), *[F.max(x).alias(x) for x in known])
    many = f.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min("_g").alias("_named")).where("_lo <> _hi").select(*keys, "_named")
    # read again by each count, so written once; a task of the counts then holds no more than their narrow rows
    f = written(f.join(many, keys), "stated")
    key = [*keys, "_v", chunk, "_a", "_z"]

    def points(t: DataFrame) -> DataFrame:
        ends = t.select(*key, c("_z").alias("_t"), F.lit(0).alias("_o"), c("_z").isNull().cast("int").alias("_x"))
        return ends.unionByName(t.select(*key, c("_a").alias("_t"), F.lit(1).alias("_o"), (-c("_a").isNull().cast("int")).alias("_x")))

    so_far = lambda *by: Window.partitionBy(*by).orderBy("_x", "_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    # starts before an end, less ends up to a start
    met = lambda w: F.when(c("_o") == 0, F.sum("_o").over(w)).otherwise(-F.sum(1 - c("_o")).over(w))
    # groups dealt by the number of facts, so that a task's rows do not grow with the table
    tasks = f.count() // FACTS_A_TASK + 1
    counted = lambda t, wide, narrow: points(t).repartition(tasks, *keys).withColumn("_n", met(wide) - met(narrow)).groupBy(*key).agg(F.sum("_n").alias("_n"))
    # all partners, less those of the same value, less the chunk's own of other values, which few chunks have
    twofold = f.groupBy(*keys, chunk).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_lo <> _hi").select(*keys, chunk)
    others = written(counted(f, so_far(*keys), so_far(*keys, "_v")), "partners")
    own = counted(f.join(twofold, [*keys, chunk], "left_semi"), so_far(*keys, chunk), so_far(*keys, chunk, "_v"))
    p = others.unionByName(own.withColumn("_n", -c("_n"))).groupBy(*key).agg(F.sum("_n").alias("_n")).where("_n > 0")
    p = p.select(*[c(x).alias(f"_p{i}") for i, x in enumerate(key)], "_n")
    p = f.join(p, reduce(lambda a, b: a & b, [c(x).eqNullSafe(c(f"_p{i}")) for i, x in enumerate(key)]))
    sides = p.groupBy(*keys).agg((F.sum("_n") / 2).cast("long").alias("n_pairs"), F.array_sort(F.collect_set(F.struct("_v", "value"))).alias("_values"), F.array_sort(F.collect_set(chunk)).alias("chunks"), F.first("_named").alias("_named"), F.max_by(chunk, F.struct(*(order or (preference([*known, chunk], chunk) if known else [c("_z").isNull(), c("_a"), c(chunk)])))).alias("preferred"))
    # the least text of each value
    shown_once = F.map_values(F.map_from_entries(F.transform(F.array_distinct(F.transform("_values", lambda x: x["_v"])), lambda v: F.struct(v, F.array_min(F.transform(F.filter("_values", lambda x: x["_v"] == v), lambda x: x["value"]))))))
    return sides.select(*[c(f"_named.{g}").alias(g) for g in group], "n_pairs", F.array_sort(shown_once).alias("conflict_values"), "chunks", "preferred")


def extractive_answers(evidence: DataFrame, query: str, quote: str = "quote", position: str = "position", most: int = 180, n: int = 3) -> DataFrame:
    """First n quotes with blanks collapsed, cut and numbered from 1; valid if every quote's number is that of one of the n positions, and none is missing.

    The answer's own markers are those at the ends of its lines: brackets inside quotes
    are the quotes' text.
    """
    short = F.substring(F.trim(F.regexp_replace(F.col(quote), r"\s+", " ")), 1, most)
    e = evidence.where(F.col(position) <= n).select(query, F.struct(F.col(position).alias("p"), F.concat(short, F.lit(" ["), F.col(position).cast("string"), F.lit("]")).alias("t")).alias("_x"))
    a = e.groupBy(query).agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    marks = F.transform("_x", lambda x: x["p"].cast("int"))
    return a.select(query, F.array_join(F.transform("_x", lambda x: x["t"]), "\n").alias("answer"), F.size("_x").alias("n_quotes"), (marks == F.sequence(F.lit(1), F.size("_x"))).alias("valid"))
