"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, quality, queries, setjoin, shared, tokens


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among ids, a written table (nulls match nulls); broadcast by its measured size, or not."""
    ids = ids.select(F.col("doc_id").alias("_gone_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_gone_id"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; rows are judged one by one.

    Null and empty texts go (no words); repeated rows are judged alike; an empty table
    stays empty; columns beside doc_id and text stay as they are, whatever their names.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of five-word shingle sets linked at 0.8.

    Texts without words are no copies of each other and stay; of rows that repeat id and
    text one stays; an id with several texts stays if one of them does; a row with a null
    id stays unless a row with an id is its copy.
    """
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    g = setjoin.groups(docs).groupBy("doc_id").agg(F.max(least).alias("_stays"), F.sum(least.cast("int")).alias("_rows"))
    g = shared.cut(g.where("not _stays or _rows > 1"), "groups")
    kept = _without(docs, g.where("not _stays"))
    if g.where("_stays").isEmpty():
        return kept
    return kept.withColumn("_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike; an id with
    several texts goes if one of them holds an item; an empty table stays empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, shared.cut(decontaminate.judge(docs, benchmark).where("contaminated").select("doc_id").distinct(), "hits"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Null and empty texts have no words and are never taken; a null source is a source of
    its own; rows that repeat an id are taken as often as each of them is; an empty table
    stays empty.
    """
    m = mixing.taken(docs).where("passes > 0").select(F.col("doc_id").alias("_mix_id"), F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))).alias("_pass"))
    return docs.join(m, docs["doc_id"].eqNullSafe(m["_mix_id"])).select(*[docs[c] for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, read back: one row for each row of docs, null texts with the end id only."""
    return tokens.digest(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", weighted_mix),
    ("token-ID / binary output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        begun = shared.mark()
        docs = shared.cut(stage(spark, docs, sf_dir), "stage")
        shared.release(begun, docs)  # what the stage wrote on its way
        if last is not None:
            shared.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
