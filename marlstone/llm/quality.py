"""Quality rules combined by weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0); the rules read counts of characters,
words and lines and know no language.  Votes of all documents are
counted by pattern (at most 3**rules rows), expectation-maximisation fits each
rule's vote distribution under the two classes to those counts, and a document is
kept when its posterior probability of being good is at least `threshold`.

Defined cases: a null or empty text has no words and fails the base rules; repeated
rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LETTERED = r"\p{L}[^\x20\x09-\x0D]*"  # once in every word with a letter: from its first letter to its end
MARKS = r"[^\p{L}\p{N}\x20\x09-\x0D]{2,}"  # marks in a row
LISTED = r"^[\x20\x09]*[-*+\u2022\u2023\u00B7]|(\.\.\.|\u2026)[\x20\x09-\x0D]*$"  # a line that begins as a list's or breaks off
RULES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "variety", "other_chars", "letterless", "marks", "listed_lines")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _windows(words: Column, k: int = 3) -> Column:
    """A hash of every k-word window of the array, by start."""
    n = F.size(words)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _in_order(hashes: Column) -> Column:
    """(h, i) of every hash in order, with its place; none where no hash occurs twice.  sort_array orders natively, array_sort by a lambda."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _characters(kind: str) -> Column:
    """How many characters of `_t` are of a class: what is left without the runs of others, so that no list of matches is built."""
    return F.length(F.regexp_replace("_t", f"[^{kind[1:-1]}]+", "")).cast("long")


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Counts that the rules read, one row for each document; with `whole` its row of docs as `_row` too.

    Each step is a projection of its own, so that arrays are built once.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *([F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if whole else []))
    d = d.withColumn("_w", _words(F.col("_t")))
    d = d.withColumn("_h", _windows(F.col("_w")))
    d = d.withColumn("_k", _in_order(F.col("_h")))
    # neighbours in hash order: a window is repeated if its hash equals the one before or after it
    last = F.size("_k") - 1
    same = F.filter(
        F.col("_k"),
        lambda x, i: ((i > 0) & (F.get(F.col("_k"), i - 1)["h"] == x["h"])) | ((i < last) & (F.get(F.col("_k"), i + 1)["h"] == x["h"])),
    )
    d = d.withColumn("_r", same)
    covered = F.array_distinct(F.flatten(F.transform(F.col("_r"), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda s: s.rlike(WORD))
    d = d.withColumn("_l", lines)
    return d.select(
        "doc_id",
        *(["_row"] if whole else []),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        _characters(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _characters(r"[\p{Lu}]").alias("n_upper"),
        _characters(r"[\p{L}]").alias("n_letters"),
        F.size(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(F.lower(w))))).cast("long").alias("n_unique"),
        _characters(r"[\p{N}]").alias("n_digits"),
        (F.size("_w") - F.regexp_count("_t", F.lit(LETTERED))).cast("long").alias("n_letterless"),
        F.regexp_count("_t", F.lit(MARKS)).cast("long").alias("n_marks"),
        F.size(F.filter("_l", lambda s: s.rlike(LISTED))).cast("long").alias("n_listed"),
    )


def votes(s: DataFrame) -> DataFrame:
    """Adds an array `_v` of votes in the order of RULES."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    mean = share("word_chars", "n_words")
    other = (F.col("word_chars") - F.col("n_letters") - F.col("n_digits")) / F.greatest("word_chars", F.lit(1))
    expected_unique = F.sqrt(F.col("n_words").cast("double"))
    each = {
        "symbols": vote(share("n_symbols", "n_words") > 0.3, share("n_symbols", "n_words") < 0.05),
        "dup_lines": vote(share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") < 0.05),
        "repeats": vote(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        "word_length": vote((mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "upper": vote(share("n_upper", "n_letters") > 0.5, share("n_upper", "n_letters") < 0.15),
        "variety": vote(F.col("n_unique") < expected_unique, F.col("n_unique") > 2 * expected_unique),
        "other_chars": vote(other > 0.15, other < 0.08),
        "letterless": vote(share("n_letterless", "n_words") > 0.2, share("n_letterless", "n_words") < 0.05),
        "marks": vote(share("n_marks", "n_words") > 0.1, share("n_marks", "n_words") < 0.03),
        "listed_lines": vote(share("n_listed", "n_lines") > 0.9, share("n_listed", "n_lines") < 0.3),
    }
    return s.withColumn("_v", F.array(*[each[r].cast("int") for r in RULES]))


def fit(voted: DataFrame, rounds: int = 60) -> dict:
    """Vote distributions by class, from the pattern counts (a table bounded by the number of rules)."""
    patterns = [(tuple(r["_v"]), r["n"]) for r in voted.groupBy("_v").agg(F.count("*").alias("n")).collect()]
    patterns.sort()
    m = len(RULES)
    total = sum(n for _, n in patterns)
    if not total:
        return {"prior": 0.5, "good": [{-1: 1 / 3, 0: 1 / 3, 1: 1 / 3}] * m, "bad": [{-1: 1 / 3, 0: 1 / 3, 1: 1 / 3}] * m}
    # start: one firm bad vote outweighs what good votes say by default
    post = [1 / (1 + math.exp(-(0.5 * sum(v for v in p if v > 0) + 2.5 * sum(v for v in p if v < 0)))) for p, _ in patterns]
    model = {}
    for _ in range(rounds):
        good = sum(q * n for q, (_, n) in zip(post, patterns))
        model = {"prior": min(max(good / total, 0.01), 0.99)}
        for name, of in (("good", lambda q: q), ("bad", lambda q: 1 - q)):
            mass = sum(of(q) * n for q, (_, n) in zip(post, patterns))
            model[name] = [{v: (sum(of(q) * n for q, (p, n) in zip(post, patterns) if p[j] == v) + 0.5) / (mass + 1.5) for v in (-1, 0, 1)} for j in range(m)]
        post = []
        for p, _ in patterns:
            odds = math.log(model["prior"] / (1 - model["prior"])) + sum(math.log(model["good"][j][v] / model["bad"][j][v]) for j, v in enumerate(p))
            post.append(1 / (1 + math.exp(-max(min(odds, 500.0), -500.0))))
    return model


def posterior(model: dict) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, (g, b) in enumerate(zip(model["good"], model["bad"])):
        w = {v: math.log(g[v] / b[v]) for v in (-1, 0, 1)}
        v = F.col("_v")[j]
        odds = odds + F.when(v == -1, w[-1]).when(v == 1, w[1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def _judged(voted: DataFrame, threshold: float, rounds: int) -> DataFrame:
    model = fit(voted.where("n_words > 0").select("_v"), rounds)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", base)
        .withColumn("posterior", posterior(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .drop("_v")
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rounds: int = 60) -> DataFrame:
    """Signals, votes, `base_failed`, `posterior` and `kept` for each row of docs."""
    # the signals are small and are read twice: texts are gone through once
    return _judged(votes(shared.cut(signals(docs, id_col, text_col), "signals")), threshold, rounds)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rounds: int = 60) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; rows travel beside their signals, so nothing is joined."""
    voted = votes(shared.cut(signals(docs, id_col, text_col, True), "signals"))
    return _judged(voted, threshold, rounds).where("kept").select("_row.*")
