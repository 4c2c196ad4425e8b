"""Nested JSON to searchable text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PREFERRED = ("title", "name", "summary", "description", "content", "text", "body")
SKIPPED = ("id", "url", "href", "uuid", "hash", "src")


def text_of(value, key: str = "", depth: int = 8) -> list[str]:
    """Preferred keys first, then the others in order; ids and urls skipped; booleans as `key: value`."""
    if depth == 0 or value is None:
        return []
    if isinstance(value, dict):
        keys = [k for k in PREFERRED if k in value] + sorted(k for k in value if k not in PREFERRED)
        return [t for k in keys if not (k.lower() in SKIPPED or k.lower().endswith(("_id", "_url"))) for t in text_of(value[k], k, depth - 1)]
    if isinstance(value, list):
        return [t for x in value for t in text_of(x, key, depth - 1)]
    if isinstance(value, bool):
        return [f"{key}: {str(value).lower()}"]
    return [f"{key}: {value}" if isinstance(value, (int, float)) else str(value).strip()] if str(value).strip() else []


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and text for each row; invalid JSON gives null."""
    kind = dict(df.dtypes)[key]

    def one(x):
        try:
            return "\n".join(text_of(json.loads(x)))
        except (TypeError, ValueError):
            return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": b[column].map(one)})

    return df.select(key, column).mapInPandas(work, f"`{key}` {kind}, text string")
