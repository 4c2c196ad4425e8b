"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other
parameters keeps its template.  Windows of template tokens are hash-joined with the
benchmark's; at each alignment of a document with an item the slots' values must map
one to one, which tells a re-parameterised question from a chance likeness.

A document is contaminated if at one alignment the matched windows reach over at least
`reach` tokens (or the whole item, if it is shorter) and their slots are consistent, or
if the windows without slots alone do; in either case they must hold four plain tokens.
Windows of slots only say nothing and are no windows; an item with too few others needs
all that it has.  It is contaminated too if it holds `reach` tokens of an item (or the
whole item) word for word, numbers and names included, whatever they are.

A window's first token may be plain or a slot by what stands before it, which may differ
between item and document; a window has both forms then.

Defined cases: null texts and texts without words match nothing; items with fewer than
four plain tokens are found word for word only, even if they are one word long; repeated
rows are judged alike; an empty benchmark leaves all documents clean; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared, textkit

# fixed values: unit words that count as units after a number
UNITS = "percent kg g mg lb lbs oz km m cm mm mi mile miles foot feet inch inches yard yards meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ton tons liter liters litre litres ml hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents degree degrees mph kmh volt volts watt watts joule joules newton newtons".split()
NUMBER, NAME, UNIT = 1, 2, 3
MARK = textkit.mix(np.asarray([0, 101, 102, 103], np.uint64))

_core = np.zeros(256, bool)
_core[48:58] = _core[65:91] = _core[97:123] = _core[128:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_numeric = _digit.copy()
_numeric[[44, 46, 58]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_stop = np.zeros(256, bool)
_stop[[10, 33, 46, 58, 63]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    s = next(textkit.slices(pa.array([" ".join(words)])))
    s.words()
    return np.sort(s.h)


UNIT_HASHES = _hash_words(UNITS)


def _total(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


class Template:
    """Template tokens of a slice: h (hash), word (hash of the token itself), kind (0 or a slot's), row offsets, start, end.

    maybe: plain tokens that would be names if they did not begin a sentence.
    """

    def __init__(self, s: textkit.Slice):
        s.words()
        d = s.data
        core = np.flatnonzero(_core[d])
        i, j = np.searchsorted(core, s.start), np.searchsorted(core, s.end)
        keep = j > i
        row = s.row[keep]
        self.start, self.end = core[i[keep]], core[j[keep] - 1] + 1
        n = len(self.start)
        self.off = np.searchsorted(row, np.arange(s.rows + 1))
        self.word = textkit.Spans(textkit._BYTE[textkit.LOWER[d]]).hash(self.start, self.end)
        span = self.end - self.start
        digits, numeric, upper, stops = (_total(f[d]) for f in (_digit, _numeric, _upper, _stop))
        within = lambda t: t[self.end] - t[self.start]
        number = (within(numeric) == span) & (within(digits) > 0)
        first = np.ones(n, bool)
        first[1:] = (row[1:] != row[:-1]) | (stops[self.start[1:]] - stops[self.end[:-1]] > 0)
        lead = d[self.start] if n else np.zeros(0, np.uint8)
        second = d[np.minimum(self.start + 1, max(len(d) - 1, 0))] if n else lead
        accent = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        shape = (span > 1) & ((_upper[lead] & (within(upper) == 1)) | (accent & (within(upper) == 0)))
        name = ~first & shape
        unit = np.isin(self.word, UNIT_HASHES)
        if n:
            unit &= np.concatenate([[False], number[:-1] & (row[1:] == row[:-1])])
        self.kind = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, 0)))
        self.maybe = shape & (self.kind == 0)
        self.h = np.where(self.kind > 0, MARK[self.kind], self.word)


def windows(d: DataFrame, lengths: tuple[int, ...] | None, width: int, reach: int, bitmap: np.ndarray | None) -> DataFrame:
    """rid, pos, wh, w, slots, plain (positions of plain tokens), other (form by the other kind of first token), tokens, kept of windows.

    w is the length of a template window, and less than 0 for a window of -w literal
    tokens.  For items (lengths None) each has template windows of min(width, tokens)
    tokens and literal ones of min(reach, tokens); kept is the number of its template
    windows.  For documents there are windows of every length of `lengths` that the
    bitmap lets pass.
    """
    held = d.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    items = lengths is None
    kind = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("wh", pa.int64()), ("w", pa.int32()), ("slots", pa.list_(pa.string())), ("plain", pa.list_(pa.int64())), ("other", pa.bool_()), ("tokens", pa.int64()), ("kept", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = np.asarray(b.column(0))
            for s in textkit.slices(b.column(1)):
                t = Template(s)
                spans, words, slots = textkit.Spans(t.h), textkit.Spans(t.word), _total(t.kind > 0)
                count = np.diff(t.off)
                for w in lengths or (*range(1, width + 1), *range(-reach, 0)):
                    n = abs(w)
                    per = np.maximum(count - n + 1, 0)
                    if items and n < (width if w > 0 else reach):
                        per = np.where(count == n, 1, 0)
                    at = textkit.ranges(t.off[:-1], per)
                    own = np.repeat(np.arange(s.rows), per)
                    kept = np.zeros(s.rows, np.int64)
                    forms = [(at, own, None)]
                    if w > 0:
                        ok = slots[at + n] - slots[at] < n
                        at, own = at[ok], own[ok]
                        kept = np.bincount(own, minlength=s.rows)
                        two = (t.kind[at] == NAME) | (t.kind[at] == UNIT) | t.maybe[at]
                        forms = [(at, own, False), (at[two], own[two], True)]
                    for at, own, other in forms:
                        h = (spans if w > 0 else words).hash(at, at + n)
                        if other:
                            h = spans.hash(at, at + n, np.where(t.kind[at] > 0, t.word[at], MARK[NAME]))
                        h = h.view(np.int64)
                        if held is not None:
                            inside = shared.within(held.value, h)
                            at, own, h = at[inside], own[inside], h[inside]
                        if not len(at):
                            continue
                        values, plain = [[]] * len(at), [[]] * len(at)
                        if w > 0:
                            # in the other form the first token changes sides
                            is_slot = lambda q, p: (t.kind[q] > 0) != (bool(other) and q == p)
                            values = [[s.data[t.start[q] : t.end[q]].tobytes().lower().decode("utf-8", "replace") for q in range(p, p + n) if is_slot(q, p)] if other or m else [] for p, m in zip(at.tolist(), (slots[at + n] - slots[at]).tolist())]
                            if items:
                                plain = [[q - o for q in range(p, p + n) if not is_slot(q, p)] for p, o in zip(at.tolist(), t.off[own].tolist())]
                        yield pa.record_batch([pa.array(rid[s.first + own]), pa.array(at - t.off[own]), pa.array(h), pa.array(np.full(len(at), w, np.int32)), pa.array(values, pa.list_(pa.string())), pa.array(plain, pa.list_(pa.int64())), pa.array(np.full(len(at), bool(other))), pa.array(count[own]), pa.array(kept[own])], schema=kind)

    return d.select("rid", "text").mapInArrow(work, "rid long, pos long, wh long, w int, slots array<string>, plain array<long>, other boolean, tokens long, kept long")


def find(d: DataFrame, benchmark: DataFrame, width: int = 8, reach: int = 13, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """rid, item_id, windows, exact for every contaminated pair of a row and an item.  d: rid, text."""
    c = F.col
    items = benchmark.select(c(item_col).cast("long").alias("rid"), F.coalesce(c(item_text), F.lit("")).alias("text"))
    bench = windows(items, None, width, reach, None)
    bench = bench.select(c("rid").alias("item_id"), c("pos").alias("bpos"), "wh", "w", c("slots").alias("bslots"), c("plain").alias("bplain"), c("other").alias("bother"), c("tokens").alias("btokens"), c("kept").alias("bkept"))
    lengths = tuple(sorted(r["w"] for r in bench.select("w").distinct().collect()))  # at most `width` + `reach` of them
    if not lengths:
        return d.select("rid", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("windows"), F.lit(False).alias("exact")).where("false")
    found = windows(d, lengths, width, reach, repeats.sieve(bench.select(c("wh").alias("rid")))).select("rid", "pos", "wh", "w", "slots", "other")
    hits = found.join(bench, ["wh", "w"])
    pairs = F.arrays_zip(c("bslots").alias("b"), c("slots").alias("d"))
    template, full = c("w") > 0, ~c("bother") & ~c("other") & (F.size("bplain") >= 4)
    number = lambda x: F.size(F.collect_set(x)).cast("long")
    at = hits.groupBy("rid", "item_id", (c("pos") - c("bpos")).alias("shift")).agg(
        number(F.when(template, c("bpos"))).alias("windows"),
        number(F.when(template & full, c("bpos"))).alias("full"),
        number(F.when(template & (F.size("bslots") == 0), c("bpos"))).alias("plain"),
        number(F.when(~template, c("bpos"))).alias("literal"),
        F.max("w").alias("w"),
        F.max("btokens").alias("btokens"),
        F.max("bkept").alias("bkept"),
        F.size(F.array_distinct(F.flatten(F.collect_set("bplain")))).alias("firm"),
        F.array_distinct(F.flatten(F.collect_set(F.when(template, pairs)))).alias("map"),
        F.array_distinct(F.flatten(F.collect_set(F.when(template & full, pairs)))).alias("full_map"),
    )
    side = lambda m, x: F.size(F.array_distinct(F.transform(m, lambda p: p[x]))) == F.size(m)
    one = lambda m: side(m, "b") & side(m, "d")
    every = F.least(F.lit(reach), c("btokens")) - c("w") + 1
    need = F.least(every, c("bkept"))
    # windows beside the full ones can add links, and take none away
    ok = (c("windows") > 0) & (c("firm") >= 4) & (((c("windows") >= need) & one("map")) | ((c("full") >= every) & one("full_map")) | (c("plain") >= need))
    exact = F.when(ok, F.forall("map", lambda p: p["b"] == p["d"]))
    per = at.where(ok | (c("literal") > 0)).groupBy("rid", "item_id").agg(F.max(F.when(ok, c("windows")).otherwise(c("literal"))).alias("windows"), F.max(exact).alias("exact"))
    return per.withColumn("exact", F.coalesce("exact", F.lit(True)))  # found word for word only


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, contaminated, n_windows, item_ids, reworded_ids (matched with other slot values) for each row of docs."""
    d = repeats.rows(docs, id_col, text_col)
    per = find(d.select("rid", "text"), benchmark, **how).groupBy("rid").agg(F.sum("windows").alias("_n"), F.sort_array(F.collect_set("item_id")).alias("_items"), F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("item_id")))).alias("_other"))
    none = F.array().cast("array<bigint>")
    out = d.select("doc_id", "rid").join(per, "rid", "left")
    return out.select("doc_id", F.col("_n").isNotNull().alias("contaminated"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("_items", none).alias("item_ids"), F.coalesce("_other", none).alias("reworded_ids"))
