"""Corpus preparation: one table in, one table out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import nfkc

# fixed values: query keys that only track, beside utm_*
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref_src")
# fixed values: lines that are page chrome
BOILERPLATE = r"(?i)^(?:accept (?:all )?cookies?|cookie (?:settings|preferences|policy)|privacy preferences|skip to (?:main )?content|back to top)$"


SAFE = "/%:@!$&'()*+,;=-._~"  # fixed value: marks that stay as they are in a path


@F.pandas_udf(StringType())
def _ascii_host(s: pd.Series) -> pd.Series:
    def one(h: str) -> str:
        try:
            return h.encode("idna").decode("ascii")
        except UnicodeError:
            return h

    return s.map(lambda h: None if h is None else one(h))


@F.pandas_udf(StringType())
def _quoted_path(s: pd.Series) -> pd.Series:
    from urllib.parse import quote

    return s.map(lambda p: None if p is None else quote(p, safe=SAFE))


@F.pandas_udf(ArrayType(StructType([StructField("k", StringType()), StructField("v", StringType())])))
def _decoded_pairs(s: pd.Series) -> pd.Series:
    from urllib.parse import parse_qsl

    return s.map(lambda q: [] if q is None else [{"k": k, "v": v} for k, v in parse_qsl(q, keep_blank_values=True)])


@F.pandas_udf(StringType())
def _encoded(s: pd.Series) -> pd.Series:
    from urllib.parse import quote_plus

    return s.map(lambda x: None if x is None else quote_plus(x))


def canonical_url(u: Column) -> Column:
    """Lower-case scheme, ASCII host (IDNA), no default port, fragment or tracking keys, user info kept, clean path in percent form, query pairs decoded, sorted and encoded; relative ids stay.

    An address that begins with // or with a host name gets https.  Only rows with
    characters beyond the plain ones leave the JVM.
    """
    u = nfkc(F.trim(F.coalesce(u, F.lit(""))))
    bare = F.regexp_replace(u, r"#.*$", "")
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:[/?#]|$)"), F.concat(F.lit("https://"), u)).otherwise(u)
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.regexp_extract(u, form, i)
    scheme, place = F.lower(part(1)), part(2)
    user, host = F.regexp_extract(place, r"^(.*@)", 1), F.lower(F.regexp_replace(place, r"^.*@", ""))
    name, port = F.regexp_replace(host, r":\d*$", ""), F.regexp_extract(host, r":(\d+)$", 1)
    name = F.when(name.rlike(r"[^\x00-\x7F]"), _ascii_host(name)).otherwise(name)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.concat(user, name, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    names = F.filter(F.split(F.regexp_replace(part(3), r"/{2,}", "/"), "/"), lambda s: (s != "") & (s != "."))
    start = F.array().cast("array<string>")
    clean = F.concat_ws("/", F.aggregate(names, start, lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))))
    clean = F.when(clean.rlike(r"[^A-Za-z0-9/%:@!$&'()*+,;=._~-]"), _quoted_path(clean)).otherwise(clean)
    simple = F.transform(F.filter(F.split(part(4), "&"), lambda q: q != ""), lambda q: F.struct(F.substring_index(q, "=", 1).alias("k"), F.when(q.contains("="), F.substring(q, F.instr(q, F.lit("=")) + 1, F.length(q))).otherwise("").alias("v")))
    odd = part(4).rlike(r"[^A-Za-z0-9_.~&=-]") | part(4).rlike(r"=[^&]*=")
    pairs = F.when(odd, _decoded_pairs(part(4))).otherwise(simple)
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING)))
    # one text for all pairs, so that it can be encoded at once: no encoded text has a line end
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("\x02"), p["v"])), "\x01")
    query = F.when(odd, F.replace(F.replace(_encoded(joined), F.lit("%01"), F.lit("&")), F.lit("%02"), F.lit("="))).otherwise(F.replace(F.replace(joined, F.lit("\x01"), F.lit("&")), F.lit("\x02"), F.lit("=")))
    out = F.concat(scheme, F.lit("://"), host, F.lit("/"), clean, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u.rlike(form), out).otherwise(bare)


def canonical_urls(pages: DataFrame) -> DataFrame:
    """Canonical url and the pages that share it."""
    p = pages.select("page_id", canonical_url(F.col("url")).alias("canonical_url"))
    return p.groupBy("canonical_url").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def collapse_lines(docs: DataFrame) -> DataFrame:
    """Drops boilerplate lines and lines equal to the last non-empty line before them (case folded)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.lower(F.trim("line"))
    lines = lines.withColumn("_k", F.nullif(key, F.lit(""))).where(F.col("_k").isNull() | ~key.rlike(BOILERPLATE))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.withColumn("_last", F.last("_k", ignorenulls=True).over(w)).where(F.col("_k").isNull() | ~F.col("_k").eqNullSafe(F.col("_last")))
    out = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return out.select("doc_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"), F.size("_l").cast("long").alias("n_lines"))


def drop_repeat_blocks(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """First of equal blocks inside each document (case folded): doc_id, pos, block."""
    b = docs.select("doc_id", F.posexplode(F.split("text", sep)).alias("pos", "block")).where(F.trim("block") != "")
    w = Window.partitionBy("doc_id", F.lower("block")).orderBy("pos")
    return b.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_link(base: Column, href: Column) -> Column:
    """An absolute, canonical address of href as it stands on the page at base."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
    return canonical_url(full)


def resolved_links(a: DataFrame, prefix: str | None = None) -> DataFrame:
    """First of equal absolute addresses of each page: page_id, pos, link, same_origin and what else the links have.  a: page_id, url, pos, href."""
    rest = [c for c in a.columns if c not in ("page_id", "url", "pos", "href")]
    a = a.where(~F.lower("href").rlike(r"^(#|mailto:|javascript:|tel:|data:)") & (F.col("href") != ""))
    site = lambda c: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    a = a.withColumn("link", resolve_link(F.col("url"), F.trim("href"))).withColumn("same_origin", site(F.col("link")) == site(canonical_url(F.col("url"))))
    if prefix is not None:
        a = a.where(F.col("same_origin") & F.regexp_extract("link", r"^[^:]+://[^/]*([^?#]*)", 1).startswith(prefix))
    w = Window.partitionBy("page_id", "link").orderBy("pos")
    return a.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("page_id", "pos", "link", "same_origin", *rest)


def visible_text(pages: DataFrame, least: int = 200) -> DataFrame:
    """Visible length without scripts, styles and tags; pages below `least` need rendering."""
    t = F.regexp_replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))
    n = F.coalesce(F.length(t), F.lit(0))
    return pages.select("page_id", n.cast("long").alias("visible_chars"), (n < least).alias("needs_render"))


def canonical_codes(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Adds `code` from an alias table (alias, code); unknown values keep themselves and are flagged."""
    out = df.join(F.broadcast(codes.select("alias", "code")), F.lower(F.trim(column)) == F.col("alias"), "left").drop("alias")
    return out.withColumn("known", F.col("code").isNotNull()).withColumn("code", F.coalesce("code", column))


def evidence_level(df: DataFrame, override: str, source: str, defaults: DataFrame) -> DataFrame:
    """A valid A-D override, else the default of the source type, else D."""
    out = df.join(F.broadcast(defaults.withColumnRenamed("source", "_s")), F.col(source) == F.col("_s"), "left").drop("_s")
    return out.withColumn("evidence_level", F.coalesce(F.when(F.col(override).isin("A", "B", "C", "D"), F.col(override)), F.col("level"), F.lit("D"))).drop("level")


def parse_times(c: Column) -> Column:
    """Date-like text or an epoch (milliseconds when beyond 1e10) as a UTC time; else null."""
    number = c.try_cast("double")
    epoch = F.when(F.abs(number) > 1e10, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_seconds(number))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "dd MMM yyyy HH:mm:ss Z")
    return F.coalesce(F.when(number.isNotNull(), epoch), *[F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in formats])


def strip_page_lead(c: Column) -> Column:
    """Without what stands before the first heading, if it holds a date and a section label."""
    lead = F.regexp_extract(c, r"(?s)^(.*?)(?:^|\n)# ", 1)
    chrome = lead.rlike(r"\d{4}-\d{2}-\d{2}") & lead.rlike(r"(?i)(changelog|updates|blog|docs)")
    return F.when(chrome, F.regexp_replace(c, r"(?s)^.*?(?=(?:^|\n)# )\n?", "")).otherwise(c)
