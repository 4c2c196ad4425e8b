"""Words and features of many texts at once, against those of one text after the other; joins of rankings and documents."""

import hashlib
import math
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import retrieval
from marlstone.plans import retrieval as plans

ODD = ["", None, "a", ".", "a.b", "-a--b-", "a._b x+y/z# c++ 1.2.3-rc.1", "İstanbul Kelvin K2 ß straße", "数据 处理a数b 数", "é世é 한글 ㍿x", "\x00a\nb\n\n", "wb_a a_b a", "ＦＵＬＬ width ﬁ", "𠀀数"]


def texts():
    r = random.Random(5)
    return ODD + ["".join(r.choice("aB9._+#/- \n数é世K") for _ in range(r.randrange(60))) for _ in range(400)] + ODD


def plain_features(text):
    low = unicodedata.normalize("NFKC", text or "").lower()
    words = retrieval._WORDS.findall(low)
    n = Counter(["w:" + w for w in words] + ["wb:" + a + "_" + b for a, b in zip(words, words[1:])])
    n.update(f"c{k if k > 1 else ''}:{x[i : i + k]}" for x in retrieval._HAN.findall(low) for k in (1, 2, 3) for i in range(len(x) - k + 1))
    return n


def test_words_of_many_texts():
    rows = texts()
    words = [Counter(retrieval._words(t)) for t in rows]
    asked = {w: i for i, w in enumerate(sorted(set().union(*words))[::2])}
    row, term, n, length = retrieval._met([rows, rows[::-1]], [1, 3], asked)
    want = [w + Counter({t: 3 * m for t, m in v.items()}) for w, v in zip(words, words[::-1])]
    assert length.tolist() == [w.total() for w in want]
    assert dict(zip(zip(row.tolist(), term.tolist()), n.tolist())) == {(i, asked[t]): m for i, w in enumerate(want) for t, m in w.items() if t in asked}
    assert (np.diff(row) >= 0).all()


def test_vectors_of_many_texts(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(retrieval, "CHARS", 1000)  # several portions
    d = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    got = {r.id: r.embedding for r in retrieval.hash_vectors(d, "id", "text", 16).collect()}
    sparse = {r.id: dict(r.x) for r in retrieval.hash_embed(d, "id", "text", 16).groupBy("id").agg(F.collect_list(F.struct("bucket", "value")).alias("x")).collect()}
    for i, t in enumerate(rows):
        v, hit = [0.0] * 16, set()
        for f, n in plain_features(t).items():
            h = hashlib.md5(f.encode()).hexdigest()
            hit.add(int(h[:8], 16) % 16)
            v[int(h[:8], 16) % 16] += (1 + math.log(n)) * (1 if h[8] in "13579bdf" else -1)
        norm = math.sqrt(sum(x * x for x in v))
        if norm < 1e-12:
            continue
        assert np.allclose(got[i], np.array(v) / norm)
        assert set(sparse[i]) == hit and all(math.isclose(x, got[i][k]) for k, x in sparse[i].items())


def test_documents_stay_where_they_are(spark, tmp_path):
    """Rankings are sent to the documents: no text is shuffled for a join."""
    spark.createDataFrame([(i, f"alpha beta n{i}", "src1", "en", 600) for i in range(50)], "doc_id long, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha n3"), (2, "beta n4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    plan = plans.candidates(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInPandas" not in plan  # the ranking is a file of known, small size
    assert sorted({r.item_id for r in plans.quotes(table).collect()}) == [1, 2]
