"""Audit rules over document tables: contents, stored labels, and the captures that documents come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import canonical_url

FALLBACK_TITLE = "Untitled document"  # fixed value: what a cleaner writes where a page has no title

# findings that fail a document; all others ask for a review
FAILS = (
    "hash_mismatch", "url_invalid", "url_not_canonical", "bad_interval", "current_has_end", "historical_lacks_end", "event_mismatch", "review_flag_mismatch",
    "capture_missing", "payload_missing", "path_mismatch", "source_mismatch", "competitor_mismatch", "acquisition_error", "status_invalid", "payload_hash_mismatch", "document_hash_mismatch",
)
TIMES = ("publish_time", "crawl_time", "valid_from", "valid_to")


def content_checks(docs: DataFrame, now: Column, minima: dict[str, int] | None = None, least: int = 80) -> DataFrame:
    """docs with `findings`: an array of codes, each rule over the columns it needs where docs have them.

    content and content_hash: hash_mismatch.  url: url_invalid (no absolute web address) or
    url_not_canonical.  content and source_type: too_short, by the source's minimum, `least`
    for sources without one.  title: untitled (the fallback, or none).  Times over a day
    after `now`: future_time.  valid_from, valid_to: bad_interval.  is_current, valid_to:
    current_has_end, historical_lacks_end.  Nulls break no rule, but for url and title.
    """
    has, c = set(docs.columns), F.col
    rules = []
    if {"content", "content_hash"} <= has:
        rules.append(F.when(F.sha2(c("content"), 256) != c("content_hash"), "hash_mismatch"))
    if "url" in has:
        web = F.coalesce(c("url"), F.lit("")).rlike(r"^(?i:https?)://[^/?#]+")
        rules.append(F.when(~web, "url_invalid").when(canonical_url(c("url")) != c("url"), "url_not_canonical"))
    if {"content", "source_type"} <= has:
        need = F.lit(least)
        for kind, n in (minima or {}).items():
            need = F.when(c("source_type") == kind, n).otherwise(need)
        rules.append(F.when(F.length("content") < need, "too_short"))
    if "title" in has:
        rules.append(F.when(F.coalesce(c("title"), F.lit(FALLBACK_TITLE)) == FALLBACK_TITLE, "untitled"))
    late = [c(t) > now + F.expr("interval 24 hours") for t in TIMES if t in has]
    if late:
        rules.append(F.when(F.exists(F.array(*late), lambda x: x), "future_time"))
    if {"valid_from", "valid_to"} <= has:
        rules.append(F.when(c("valid_to") < c("valid_from"), "bad_interval"))
    if {"is_current", "valid_to"} <= has:
        rules.append(F.when(c("is_current") & c("valid_to").isNotNull(), "current_has_end").when(~c("is_current") & c("valid_to").isNull(), "historical_lacks_end"))
    return docs.withColumn("findings", F.array_compact(F.array(*rules)))


def label_drift(stored: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and `findings` of each stored row: how its labels differ from those of labels.label now.

    Both have event_type, dimension_tags, confidence, reasons and needs_review; stored may
    have needs_browser, which adds a reason and asks for review.  Compared null-safe; a
    stored row without a recomputed one differs in all.  Labels that agree but are absent
    or weak are findings too (no_dimension, low_confidence).
    """
    c = F.col
    s = stored if "needs_browser" in stored.columns else stored.withColumn("needs_browser", F.lit(False))
    n = now.select(c(key).alias("_k"), *[c(x).alias(f"_{x}") for x in ("event_type", "dimension_tags", "confidence", "reasons", "needs_review")])
    j = s.join(n, c(key).eqNullSafe(c("_k")), "left")
    browser = F.coalesce(c("needs_browser"), F.lit(False))
    reasons = F.when(browser, F.concat_ws(";", F.nullif(c("_reasons"), F.lit("")), F.lit("source:needs_browser"))).otherwise(c("_reasons"))
    unlike = lambda x, y, code: F.when(~x.eqNullSafe(y), code)
    none = F.coalesce(F.size("dimension_tags"), F.lit(0)) <= 0
    f = F.array(
        unlike(c("event_type"), c("_event_type"), "event_mismatch"),
        unlike(c("dimension_tags"), c("_dimension_tags"), "dimension_mismatch"),
        unlike(F.round("confidence", 6), F.round("_confidence", 6), "confidence_mismatch"),
        unlike(c("reasons"), reasons, "reasons_mismatch"),
        unlike(c("needs_review"), c("_needs_review") | browser, "review_flag_mismatch"),
        F.when(~none & (F.size(F.array_except("dimension_tags", F.coalesce("_dimension_tags", F.array().cast("array<string>")))) > 0), "evidence_missing"),
        F.when(none, "no_dimension").when(c("_needs_review"), "low_confidence"),
        F.when(browser, "needs_browser"),
    )
    return j.select(key, F.array_compact(f).alias("findings"))


def lineage_checks(docs: DataFrame, captures: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and `findings` of each document against the capture it names (raw_record_id).

    docs: key, raw_record_id, raw_path, source_type, competitor, payload_hash (null: not
    stated).  captures: raw_record_id, one row each, path, source_type, competitor, error,
    http_status, payload_hash (as stated beside it), digest (of the payload as it is, null
    where there is none).  A null raw_record_id names no capture.
    """
    c = F.col
    of = captures.select(*[c(x).alias(f"_{x}") for x in ("raw_record_id", "path", "source_type", "competitor", "error", "http_status", "payload_hash", "digest")])
    j = docs.join(of, c("raw_record_id") == c("_raw_record_id"), "left")
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    f = F.array(
        F.when(c("_digest").isNull(), "payload_missing"),
        F.when(~c("raw_path").eqNullSafe(c("_path")), "path_mismatch"),
        F.when(~c("source_type").eqNullSafe(c("_source_type")), "source_mismatch"),
        F.when((plain(c("competitor")) != "") & (plain(c("competitor")) != plain(c("_competitor"))), "competitor_mismatch"),
        F.when(F.coalesce("_error", F.lit("")) != "", "acquisition_error"),
        F.when(~F.coalesce(c("_http_status").between(200, 299), F.lit(False)), "status_invalid"),
        F.when(c("_digest").isNotNull() & ~c("_digest").eqNullSafe(c("_payload_hash")), "payload_hash_mismatch"),
        F.when(c("payload_hash").isNotNull() & ~c("payload_hash").eqNullSafe(c("_payload_hash")), "document_hash_mismatch"),
    )
    return j.select(key, F.when(c("_raw_record_id").isNull(), F.array(F.lit("capture_missing"))).otherwise(F.array_compact(f)).alias("findings"))
