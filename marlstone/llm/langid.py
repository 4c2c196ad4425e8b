"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; one linear n-gram classifier for each bit tells the
languages with a 1 from those with a 0.  Decoding sums each codeword's logistic loss
over all bits and picks the least; a small gap to the runner-up flags ambiguity.

Classifier weights are log odds of n-gram frequencies, from counts over all training
rows; the model is a bounded table (buckets x languages).

Defined cases: null texts and texts without a letter are `und` with score 0; a table
without training rows predicts `und`; rows with a null lang train nothing; repeated
rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

BUCKETS = 1 << 14
LETTER = re.compile(r"[^\W\d_]")


def grams(s: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte trigram and bigram inside a row (ASCII case folded)."""
    d = textkit.LOWER[s.data].astype(np.uint32)
    row = np.repeat(np.arange(s.rows, dtype=np.int32), np.diff(s.off))
    out, rows = [], []
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(d) < n:
            continue
        code = d[: len(d) - n + 1].copy()
        for j in range(1, n):
            code = (code << np.uint32(8)) | d[j : len(d) - n + 1 + j]
        keep = row[: len(code)] == row[n - 1 :]
        out.append(((code * np.uint32(salt)) >> np.uint32(32 - 14))[keep])
        rows.append(row[: len(code)][keep])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def counts(train: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of (text, lang)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        total: list[np.ndarray] = []
        for b in batches:
            code = np.asarray([langs.setdefault(x, len(langs)) for x in b.column(1).to_pylist()], np.int64)
            while len(total) < len(langs):
                total.append(np.zeros(BUCKETS, np.int64))
            for s in textkit.slices(b.column(0)):
                g, r = grams(s)
                own = code[s.first : s.first + s.rows][r]
                for k in np.unique(own):
                    total[k] += np.bincount(g[own == k], minlength=BUCKETS)
        for name, k in langs.items():
            at = np.flatnonzero(total[k])
            if len(at):
                yield pa.record_batch([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[k][at], pa.int64())], names=["lang", "bucket", "n"])

    return train.mapInArrow(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1/-1: the exhaustive code for few languages, else spread-out binary words."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = (1 << (n - 1)) - 1
        rows = [np.ones(bits)]
        for i in range(1, n):
            run = 1 << (n - 1 - i)
            rows.append(np.asarray([-1.0 if (j // run) % 2 == 0 else 1.0 for j in range(bits)]))
        return np.vstack(rows)
    width, best = 4 * int(np.ceil(np.log2(n))) + 3, None
    for seed in range(64):
        m = np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (n, width))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        gap = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


def fit(train: DataFrame, smooth: float = 0.5) -> dict:
    """Model from a frame of (text, lang): languages, codewords, weights[bit][bucket]."""
    rows = counts(train).collect()  # at most BUCKETS rows a language
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((len(langs), BUCKETS))
    for r in rows:
        table[langs.index(r["lang"]), r["bucket"]] = r["n"]
    share = (table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * BUCKETS)
    code = codewords(len(langs))
    weights = np.zeros((code.shape[1] if len(langs) else 0, BUCKETS), np.float32)
    if len(langs) > 1:
        for b in range(code.shape[1]):
            weights[b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    return {"langs": langs, "code": code, "weights": weights}


def decode(scores: np.ndarray, code: np.ndarray, sharp: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-loss codeword, its share of the loss-weighted mass, and the gap to the runner-up."""
    loss = np.logaddexp(0.0, -sharp * scores[:, None, :] * code[None, :, :]).sum(axis=2)
    best = loss.argmin(axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0.0)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", gap: float = 0.2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, lang_pred, score, ambiguous for every row."""
    langs, code, weights = model["langs"], model["code"], model["weights"]
    frame = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            lang = np.full(n, "und", object)
            score, unsure = np.zeros(n), np.ones(n, bool)
            for s in textkit.slices(b.column(0)):
                has = np.fromiter((LETTER.search(s.text(i).decode("utf-8", "replace")) is not None for i in range(s.rows)), bool, s.rows)
                if not langs or not has.any():
                    continue
                g, r = grams(s)
                per = np.maximum(np.bincount(r, minlength=s.rows), 1)
                bits = np.stack([np.bincount(r, weights=w[g], minlength=s.rows) / per for w in weights], axis=1)
                best, p, d = decode(bits, code)
                at = s.first + np.flatnonzero(has)
                lang[at] = np.asarray(langs, object)[best[has]]
                score[at], unsure[at] = np.clip(p[has], 0, 1), d[has] < gap
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*b.schema.names[1:], "lang_pred", "score", "ambiguous"])

    kinds = dict(frame.dtypes)
    return frame.mapInArrow(work, ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)] + ["lang_pred string, score double, ambiguous boolean"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from rows whose crc32(id) mod 4 is not 2 and predicts all rows: doc_id, held_out, lang_pred, score, ambiguous."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = fit(d.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    return predict(d, model, carry=("held_out",))
