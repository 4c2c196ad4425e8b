"""Extension points: functions of a user's that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import minmax


def fact_extractor(chunks: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Table function: chunk batches to fact rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield extract(b)

    return chunks.mapInPandas(work, schema)


def quote_selector(select: Callable[[str, str], str]) -> Callable[[Column, Column], Column]:
    """Scalar function (question, text) -> quote; a quote that is no substring of the text becomes null."""

    def pick(q: pd.Series, t: pd.Series) -> pd.Series:
        found = [select(a, b) for a, b in zip(q, t)]
        return pd.Series([x if x is not None and b is not None and x in b else None for x, b in zip(found, t)], dtype="object")

    return lambda q, t: F.pandas_udf(pick, "string")(q, t)


def pair_scores(pairs: DataFrame, query: str, question: str, text: str, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Adds pair_score by a user's scorer, scaled to 0..1 within each query."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(list(q), list(t)), dtype="float64")

    return pairs.withColumn("_p", F.pandas_udf(run, "double")(question, text)).withColumn("pair_score", minmax(F.col("_p"), query)).drop("_p")


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[DataFrame], DataFrame]:
    """Embedding of (text_hash, text) frames; the model is loaded once for each task."""

    def embed(df: DataFrame) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for b in batches:
                yield pd.DataFrame({"text_hash": b["text_hash"], "embedding": model(list(b["text"]))})

        return df.select("text_hash", "text").mapInPandas(work, "text_hash string, embedding array<float>")

    return embed
