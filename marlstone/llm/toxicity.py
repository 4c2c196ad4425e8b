"""Toxicity scores by a counterfactually regularised classifier.

A text is the set of byte n-grams (3 to 6, with marks for a word's ends) and whole words
of its lower-cased words.  A logistic regression over the n-grams that tell the labels
apart best is fitted with a penalty: in the sentences of labelled texts that mention a
group, the group's term is swapped for another one of its kind, and the squared change
of the score's log odds is added to the loss.  Weights that a mention alone would draw
are thereby pulled together, so that neutral mentions are not taken for toxicity.

The classifier is fitted on a bounded sample: at most `most` labelled rows, half of them
of each class, those with the least hashes of their ids (weights restore the classes'
shares).  n-grams of the sample are counted by executors, the `keep` best ones reach the
driver, and with them each sampled row's list of those; nothing else does.  All texts are
scored whole.

Defined cases: a null text is an empty one, which scores what the intercept says; a table
without training labels scores 0; where training labels are all of one class there is
nothing to tell apart and every text gets the class's smoothed share; a null label
teaches nothing; an id with two labels teaches both; rows that repeat an id are scored
one by one; a null id is scored and never held out; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textkit

# Terms for groups of people, by kind and language; those of one kind can stand for each other in a sentence.
IDENTITY = {
    "faith, English": ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    "faiths, English": ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"],
    "origin, English": ["african", "american", "arab", "asian", "chinese", "european", "indian", "mexican", "turkish"],
    "origins, English": ["africans", "americans", "arabs", "asians", "europeans", "indians", "mexicans", "immigrants", "refugees"],
    "colour, English": ["black", "white", "brown"],
    "gender, English": ["woman", "man"],
    "genders, English": ["women", "men"],
    "orientation, English": ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    "body, English": ["blind", "deaf", "disabled", "elderly", "young"],
    "faiths, German": ["muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"],
    "origins, German": ["afrikaner", "amerikaner", "araber", "asiaten", "europäer", "inder", "türken"],
    "genders, German": ["frauen", "männer"],
    "faiths, French": ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"],
    "origins, French": ["africains", "américains", "arabes", "asiatiques", "européens", "indiens", "turcs"],
    "genders, French": ["femmes", "hommes"],
    "faiths, Spanish": ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"],
    "origins, Spanish": ["africanos", "americanos", "árabes", "asiáticos", "europeos", "indios", "turcos"],
    "genders, Spanish": ["mujeres", "hombres"],
}

SHORTEST, LONGEST = 3, 6
SENTENCE = re.compile(r"[^.!?\n]+")


def grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of every n-gram of words given by offsets into their bytes."""
    n = len(off) - 1
    cuts = off + 2 * np.arange(n + 1)
    marked = np.ones(int(cuts[-1]), np.uint8)
    inside = np.ones(len(marked), bool)
    inside[cuts[:-1]] = inside[cuts[1:] - 1] = False
    marked[cuts[1:] - 1] = 2
    marked[inside] = data[off[0] : off[-1]]
    spans = textkit.Slice(marked, cuts, 0).bytes_hash()
    word = np.repeat(np.arange(n), np.diff(cuts))
    end = cuts[1:][word]
    h, own = [], []
    for k in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(np.arange(len(marked)) + k <= end)
        h.append(spans.hash(at, at + k))
        own.append(word[at])
    long = np.flatnonzero(np.diff(cuts) > LONGEST)
    return np.concatenate([*h, spans.hash(cuts[long], cuts[long + 1])]), np.concatenate([*own, long])


class Features:
    """The chosen n-grams, and their places in texts."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.flags = np.zeros(1 << self.BITS, bool)
        self.flags[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def of_words(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and feature of every chosen n-gram in words, by word."""
        if not len(self) or len(off) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, word = grams(off, data)
        near = np.flatnonzero(self.flags[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        h, word = h[near], word[near]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        hit = self.hashes[at] == h
        order = np.argsort(word[hit], kind="stable")
        return word[hit][order], at[hit][order]

    def of_rows(self, s: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of every feature that a row of the slice has, once each, by row."""
        s.words()
        each, off, data = s.distinct()
        word, feature = self.of_words(off, data)
        first = np.searchsorted(word, np.arange(len(off)))
        count = np.diff(first)
        held = count[each] > 0
        pair = np.unique(s.row[held] * len(off) + each[held])
        row, w = pair // len(off), pair % len(off)
        both = np.unique(np.repeat(row, count[w]) * max(len(self), 1) + feature[textkit.ranges(first[:-1][w], count[w])])
        return both // max(len(self), 1), both % max(len(self), 1)

    def of_text(self, text: str) -> tuple[int, ...]:
        got = [f for s in textkit.slices(pa.array([text])) for f in self.of_rows(s)[1].tolist()]
        return tuple(got)


def swaps(text: str, groups: list[list[str]], variants: int = 3) -> Iterator[tuple[str, str]]:
    """Each sentence that mentions a group, and itself with every term swapped for another of its kind (`variants` ways)."""
    at = {t: (g, i) for g in groups for i, t in enumerate(g)}
    if not at:
        return
    term = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, at), key=len, reverse=True)) + r")\b")
    for m in SENTENCE.finditer(text):
        found = {x for x in term.findall(m[0])}
        for v in range(1, min(variants, max((len(at[x][0]) for x in found), default=1) - 1) + 1):

            def other(x: re.Match, v: int = v) -> str:
                g, i = at[x[0]]
                return g[(i + 1 + (v - 1) % (len(g) - 1)) % len(g)] if len(g) > 1 else x[0]

            yield m[0], term.sub(other, m[0])


def sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """A written table (doc_id, text, label) of at most `most` labelled rows, and the training labels of each class."""
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).where("label in (0, 1)").distinct()
    total = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    least = [train.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for c in (0, 1)]
    # at most `most` rows of two numbers
    held = F.broadcast(least[0].unionByName(least[1]).withColumnRenamed("doc_id", "_labelled"))
    picked = docs.join(held, docs["doc_id"] == held["_labelled"]).select("doc_id", "text", "label")
    return shared.cut(picked.repartition(8), "labelled"), total


def count_grams(picked: DataFrame) -> DataFrame:
    """gram, toxic, clean: in how many sampled rows of either class each n-gram occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.asarray(b.column(0))
            for s in textkit.slices(b.column(1), 1 << 20):
                s.words()
                each, off, data = s.distinct()
                h, word = grams(off, data)
                names, h = np.unique(h, return_inverse=True)
                order = np.argsort(word, kind="stable")
                first = np.searchsorted(word[order], np.arange(len(off)))
                pair = np.unique(s.row * len(off) + each)
                row, w = pair // len(off), pair % len(off)
                per = np.diff(first)[w]
                both = np.unique(np.repeat(row, per) * max(len(names), 1) + h[order][textkit.ranges(first[:-1][w], per)])
                own, g = label[s.first + both // max(len(names), 1)], both % max(len(names), 1)
                n, bad = np.bincount(g, minlength=len(names)), np.bincount(g, weights=own, minlength=len(names)).astype(np.int64)
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["gram", "toxic", "clean"])

    return picked.select("label", "text").mapInArrow(work, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: DataFrame, toxic: int, clean: int, keep: int, seen: int = 5) -> np.ndarray:
    """Hashes of the `keep` n-grams whose presence tells the classes apart best (log-likelihood ratio), among those seen in `seen` rows."""
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    t, c, n = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    a, b = toxic / (toxic + clean), clean / (toxic + clean)
    rest = F.greatest(F.lit(toxic + clean) - n, F.lit(1e-9))
    ratio = part(t, n * a) + part(c, n * b) + part(F.lit(toxic) - t, rest * a) + part(F.lit(clean) - c, rest * b)
    best = counts.where(n >= seen).withColumn("_ratio", F.round(ratio, 6)).where("_ratio > 4").orderBy(F.desc("_ratio"), "gram").limit(keep)
    return np.asarray([r["gram"] for r in best.select("gram").collect()], np.int64).view(np.uint64)


def examples(picked: DataFrame, features: Features, groups: list[list[str]]) -> list:
    """Sampled rows' features, and the feature lists on both sides of every swap with their number."""
    held = picked.sparkSession.sparkContext.broadcast((features, groups))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, groups = held.value
        pairs: Counter = Counter()
        names = ["doc_id", "label", "has", "lacks", "n"]
        for b in batches:
            ids, label = b.column(0), b.column(1)
            for s in textkit.slices(b.column(2)):
                row, f = features.of_rows(s)
                cuts = np.searchsorted(row, np.arange(s.rows + 1))
                lists = [f[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch([ids.slice(s.first, s.rows), label.slice(s.first, s.rows), pa.array(lists, pa.binary()), pa.nulls(s.rows, pa.binary()), pa.array([1] * s.rows, pa.int64())], names=names)
                for i in range(s.rows):
                    for old, new in swaps(s.text(i).decode("utf-8", "replace"), groups):
                        x, y = set(features.of_text(old)), set(features.of_text(new))
                        if x != y:
                            pairs[tuple(sorted(y - x)), tuple(sorted(x - y))] += 1
        if pairs:
            pack = lambda side: pa.array([np.asarray(p[side], "<i4").tobytes() for p in pairs], pa.binary())
            yield pa.record_batch([pa.nulls(len(pairs), ids.type), pa.nulls(len(pairs), pa.int32()), pack(0), pack(1), pa.array(list(pairs.values()), pa.int64())], names=names)

    d = picked.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(work, f"doc_id {kind}, label int, has binary, lacks binary, n long").collect()


def _matrix(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    cols = [np.frombuffer(x, "<i4") for x in lists]
    return np.repeat(np.arange(len(cols)), [len(x) for x in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int32)


def fit(rows: list, total: dict[int, int], width: int, penalty: float = 1.0, ridge: float = 3e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of least weighted log loss + ridge + penalty * mean squared change of log odds over the swaps."""
    real = sorted((r for r in rows if r["label"] is not None), key=lambda r: (r["label"], repr(r["doc_id"]), bytes(r["has"])))
    swap = sorted((r for r in rows if r["label"] is None), key=lambda r: (bytes(r["has"]), bytes(r["lacks"])))
    y = np.asarray([r["label"] for r in real], float)
    share = np.asarray([total[int(v)] / max((y == v).sum(), 1) for v in y])
    share /= share.sum()
    row, col = _matrix([bytes(r["has"]) for r in real])
    up, upc = _matrix([bytes(r["has"]) for r in swap])
    down, downc = _matrix([bytes(r["lacks"]) for r in swap])
    n = np.asarray([r["n"] for r in swap], float)
    n = n / n.sum() if len(n) else n

    def change(w: np.ndarray) -> np.ndarray:
        return np.bincount(up, w[upc], len(swap)) - np.bincount(down, w[downc], len(swap))

    def pull(d: np.ndarray) -> np.ndarray:
        return np.bincount(upc, d[up], width) - np.bincount(downc, d[down], width)

    def curved(w: np.ndarray) -> np.ndarray:
        """An upper bound of the loss's second derivative, applied to w (the intercept last)."""
        z = np.bincount(row, w[col], len(real)) + w[-1]
        g = 0.25 * share * z
        out = np.append(np.bincount(col, g[row], width) + ridge * w[:-1], g.sum())
        if len(swap):
            out[:-1] += 2 * penalty * pull(n * change(w))
        return out

    v = np.ones(width + 1) / np.sqrt(width + 1)
    for _ in range(30):
        v = curved(v)
        steep = float(np.linalg.norm(v))
        v /= steep
    step = 1 / (1.05 * steep)
    w = np.zeros(width + 1)
    w[-1] = np.log(max(share[y == 1].sum(), 1e-6) / max(share[y == 0].sum(), 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        z = np.bincount(row, ahead[col], len(real)) + ahead[-1]
        r = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(col, r[row], width) + ridge * ahead[:-1], r.sum())
        if len(swap):
            g[:-1] += 2 * penalty * pull(n * change(ahead))
        new = ahead - step * g
        if g @ (new - w) > 0:  # overshot: start the momentum anew
            t = 1.0
        then, t = t, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (then - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, most: int = 8000, keep: int = 4096, penalty: float = 1.0, groups: dict[str, list[str]] | None = None) -> dict:
    """A model from frames (doc_id, text) and (doc_id, label): features, weights and intercept, all of bounded size."""
    picked, total = sample(docs, labels, most)
    size = {r["label"]: r["n"] for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = {"features": Features(np.zeros(0, np.uint64)), "weights": np.zeros(0), "intercept": None}
    if size.get(0) and size.get(1):
        features = Features(choose(count_grams(picked), size[1], size[0], keep))
        rows = examples(picked, features, list((IDENTITY if groups is None else groups).values()))
        weights, intercept = fit(rows, total, len(features), penalty)
        model = {"features": features, "weights": weights, "intercept": intercept}
    elif size:
        bad, good = (total.get(c, 0) + 0.5 for c in (1, 0))
        model["intercept"] = float(np.log(bad / good))
    shared.drop(picked)
    return model


def predict(docs: DataFrame, model: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, score and predicted of every row of a frame with doc_id and text (lower case)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select("text", "doc_id", *carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            z = np.full(b.num_rows, -np.inf if m["intercept"] is None else m["intercept"])
            if len(m["features"]):
                for s in textkit.slices(b.column(0), 1 << 20):
                    row, f = m["features"].of_rows(s)
                    z[s.first : s.first + s.rows] += np.bincount(row, m["weights"][f], s.rows)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            score[np.isneginf(z)] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names[1:], "score", "predicted"])

    kinds = dict(frame.dtypes)
    return frame.mapInArrow(work, ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)] + ["score double, predicted int"]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """Learns from labels of rows whose crc32(id) mod 5 is not 0 and scores all rows: doc_id, held_out, score, predicted."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    model = learn(d, marks, **options)
    return predict(d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))), model, ("held_out",))
