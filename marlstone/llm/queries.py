"""Registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared, warc

    to = shared.folder(spark, "warc")
    warc.write(warc.decide(table(spark, sf_dir, "pages")), to)
    return warc.read(spark, to).drop("url", "payload")


def op5_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shingle_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import setjoin

    return setjoin.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import preference

    return preference.digest(preference.format_pairs(preference.pair_up(table(spark, sf_dir, "conversations"))))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.remove(table(spark, sf_dir, "documents"))


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import debruijn

    return debruijn.remove(table(spark, sf_dir, "documents")).drop("n_spans")


def read_periodically(doc_id: int | None, n: int):
    """Of documents whose crc32 of the id ends in 0: word i >= a is word a + (i - a) % p of the text; other texts are read as they are."""
    import zlib

    import numpy as np

    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    return periodic.digest(periodic.detect(table(spark, sf_dir, "documents"), reorder=read_periodically))


def op12_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align

    return align.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))[0]


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_preference_pairs, op3_suffix_array_dedup, op4_warc_bundles, op5_weighted_fair_mix, op6_template_decontamination, op7_shingle_set_join, op8_language_codes, op9_debruijn_dedup, op10_quality_rules, op11_periodic_runs, op12_counterfactual_toxicity, op13_token_alignment)}

ORACLE_SQL = {
    "op2_preference_pairs": """
        WITH c AS (SELECT conv_id, list(struct_pack(a := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn, role, text) AS x
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             p AS (SELECT conv_id // 2 AS pair_id, min(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, min(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id,
                          coalesce(any_value(x) FILTER (conv_id % 2 = 0), []) AS a, coalesce(any_value(x) FILTER (conv_id % 2 = 1), []) AS b
                   FROM c GROUP BY 1),
             n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS k FROM p),
             s AS (SELECT pair_id, chosen_id, rejected_id, k, a[1:k] AS q, a[k + 1:] AS u, b[k + 1:] AS v FROM n),
             r AS (SELECT *, coalesce(array_to_string(list_transform(q, lambda z: '<|im_start|>' || z.a || chr(10) || z.t || '<|im_end|>' || chr(10)), ''), '') AS qt,
                          coalesce(array_to_string(list_transform(u, lambda z: '<|im_start|>' || z.a || chr(10) || z.t || '<|im_end|>' || chr(10)), ''), '') AS ut,
                          coalesce(array_to_string(list_transform(v, lambda z: '<|im_start|>' || z.a || chr(10) || z.t || '<|im_end|>' || chr(10)), ''), '') AS vt FROM s)
        SELECT pair_id, chosen_id, rejected_id, k AS n_common, length(qt) AS prompt_chars,
               sha256(qt) AS prompt_sha256, sha256(ut) AS chosen_sha256, sha256(vt) AS rejected_sha256,
               coalesce(list_sum(list_transform(list_filter(u, lambda z: z.a = 'assistant'), lambda z: length(z.t) + 10)), 0)::BIGINT AS chosen_train_chars,
               coalesce(list_sum(list_transform(list_filter(v, lambda z: z.a = 'assistant'), lambda z: length(z.t) + 10)), 0)::BIGINT AS rejected_train_chars
        FROM r""",
    "op9_debruijn_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             win AS (SELECT r, i, list_slice(w, i, i + 34) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
             rep AS (SELECT r, i FROM win WHERE x IN (SELECT x FROM win GROUP BY x HAVING count(*) > 1)),
             gone AS (SELECT DISTINCT r, i + j AS p FROM rep, (SELECT unnest(range(0, 35)) AS j)),
             per AS (SELECT r, list(p) AS p FROM gone GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
               sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ')
                      ELSE coalesce(array_to_string([w[q] FOR q IN list_sort(list_filter(range(1, len(w) + 1), lambda q: NOT list_contains(p, q)))], ' '), '') END) AS kept_sha256
        FROM d LEFT JOIN per USING (r)""",
    "op4_warc_bundles": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             t AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN t USING (d, n)""",
}
