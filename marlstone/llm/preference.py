"""Preference pairs: the shared turns once as prompt, then two completions with loss masks.

Defined cases: a missing side has no turns; null roles and texts render as empty and
equal each other; conversations that agree throughout give two empty completions;
repeated turns are kept (ordered by turn, role, text); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def pair_up(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, chosen_id, rejected_id, chosen, rejected (turn arrays): ids 2p and 2p+1 are a pair.

    One shuffle by pair; a group is two conversations, however large the table.
    """
    c = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    c = c.where("conv_id is not null")
    turn = F.struct("turn", "role", "text")
    side = F.pmod("conv_id", F.lit(2))
    g = c.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"))
    return g.agg(
        F.min(F.when(side == 0, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(side == 1, F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.when(side == 0, turn))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(side == 1, turn))).alias("rejected"),
    )


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column, train: str) -> Column:
    """[start, end) character spans of the rendered text that count in the loss: replies and their end marks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct((end + 1).cast("int").alias("at"), F.when(t["role"] == train, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_pairs(pairs: DataFrame, train: str = "assistant") -> DataFrame:
    """Adds n_common, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask."""
    least = F.least(F.size("chosen"), F.size("rejected"))
    at = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(at, lambda i: ~_same(F.get(F.col("chosen"), i), F.get(F.col("rejected"), i)))
    d = pairs.withColumn("n_common", F.coalesce(F.get(differ, F.lit(0)), least))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    d = d.withColumns({"_c": rest("chosen"), "_r": rest("rejected"), "_p": F.slice("chosen", F.lit(1), F.col("n_common"))})
    return d.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        _render(F.col("_p")).alias("prompt"), _render(F.col("_c")).alias("chosen_text"), _render(F.col("_r")).alias("rejected_text"),
        _mask(F.col("_c"), train).alias("chosen_mask"), _mask(F.col("_r"), train).alias("rejected_mask"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(F.col(c), F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return formatted.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), F.length("prompt").cast("long").alias("prompt_chars"),
        F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen_text", 256).alias("chosen_sha256"), F.sha2("rejected_text", 256).alias("rejected_sha256"),
        total("chosen_mask").alias("chosen_train_chars"), total("rejected_mask").alias("rejected_train_chars"),
    )
