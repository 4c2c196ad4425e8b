"""Many keywords in many texts: one automaton, one pass over each text, hits with their places."""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<term:string,at:int>>"
MOST = 200_000  # terms in one automaton (some 100 bytes for each of their characters)
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(8)
def automaton(terms: tuple[str, ...]):
    """Aho-Corasick automaton of the terms, once for each worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        if t:
            a.add_word(t, t)
    a.make_automaton()
    return a


def is_cjk(term: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in term)


def bounded(text: str, begin: int, end: int, plural: bool) -> bool:
    """Whether text[begin:end] is a whole token, alone or with a plural ending."""
    if begin and text[begin - 1] in ALNUM:
        return False
    rest = text[end : end + 3]
    ends = [0] + ([1] if rest[:1] == "s" else [2] if rest[:2] == "es" else []) * plural
    return any(len(rest) <= k or rest[k] not in ALNUM for k in ends)


def find(text: str | None, terms: tuple[str, ...], tokens: bool) -> list[dict]:
    """First place of each term in the text, by term; with `tokens` Latin terms count as whole tokens, with an optional plural."""
    out: dict[str, int] = {}
    a = automaton(terms)
    if not text or not len(a):
        return []
    for last, t in a.iter(text):
        if t not in out:
            begin = last + 1 - len(t)
            if not tokens or is_cjk(t) or bounded(text, begin, last + 1, t[-1].isalnum()):
                out[t] = begin
    return [{"term": t, "at": out[t]} for t in sorted(out)]


def occurrences(text: Column, terms: list[str], tokens: bool = False) -> Column:
    """Array of (term, at): which of the terms a text holds and where first; texts and terms in lower case, null holds none."""
    own = tuple(sorted(set(terms)))
    if len(own) > MOST:
        raise ValueError(f"{len(own)} terms; use occurring() for tables of terms")

    @F.pandas_udf(HITS)
    def hits(s: pd.Series) -> pd.Series:
        return s.map(lambda x: find(x, own, tokens))

    return hits(text)


def held(hits: Column, terms: list[str]) -> Column:
    """Those of the terms, in their order, that the hits name."""
    found = F.transform(hits, lambda x: x["term"])
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(found, t))


def occurring(df: DataFrame, id_col: str, text: Column, terms: DataFrame, term: str, most: int = MOST, tokens: bool = False) -> DataFrame:
    """id, term, at for every term of a table that a text holds: one pass for each block of at most about `most` distinct terms."""
    own = terms.select(F.lower(term).alias("term")).where("term <> ''").distinct()
    n = own.count()
    blocks = max(1, -(-n // most))
    parts = []
    for k in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        names = [r["term"] for r in block.collect()]
        step = max(1, -(-len(names) // MOST))  # a block by hash may be a little larger than its share
        for j in range(step):
            parts.append(df.select(id_col, F.explode(occurrences(text, names[j::step], tokens)).alias("_x")).select(id_col, "_x.term", "_x.at"))
    return reduce(DataFrame.unionByName, parts)
