"""Each training-data operator on small tables with nulls, ties, repeats, long texts and clashing columns, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import debruijn, decontaminate, graph, langid, mixing, preference, quality, queries, repeats, setjoin, shared, suffixes, textkit, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    base, passage = text(90), text(60)
    out = [text(r.randint(0, 150)) for _ in range(30)]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 99))
        out.append(" ".join(w))
    out += [text(20) + " " + passage + " " + text(15) for _ in range(12)]
    out += [None, "", "   \n", "one", "One", "ab cd", "AB\tcd", "x " * 3000, text(6000), base, base, "a\x0bb\x1cc\x85d e"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 17 == 0 else f"s{i % 4 if i % 3 else 0}", "en", 7, "gram", i) for i, t in enumerate(corpus())]
    rows.append(rows[-2])  # a repeated row
    # size, piece, rid and start clash with names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, piece string, start int")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(got, want):
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


def test_tokens(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(texts, key=lambda x: (x[0], len(x[1] or ""))):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    same([tuple(r) for r in tokens.digest(docs, path).drop("part").collect()], want)
    assert tokens.digest(empty, path).count() == 0


def test_encoder():
    """Ids of texts put together from pieces are those of whole texts, on odd strings and on whole tables."""
    import duckdb
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, r = Tokenizer.from_file(path), random.Random(1)
    bits = ["a", "the", "é", " ", "  ", "\n", "\t", "\x1c", "'s", "don't", ".", ",", "!!", "12", "½", "日本", "|", "<|endoftext|>", "　", "İ", "\x85", "\xa0", "ß"]
    odd = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(4000)] + [None, "", "x " * 5000, "y" * 5000]
    tables = [[x for (x,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()] for sf in ("sf0.001", "sf0.01")]
    for texts, most in ((odd, 50), *((t, 200_000) for t in tables)):
        enc, got, lens = tokens.Encoder(path, most), [], []
        for s in textkit.slices(pa.array(texts, pa.string()), 1 << 16):
            ids, n = enc.encode(s)
            got.append(ids)
            lens.append(n)
        want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert np.concatenate(lens).tolist() == [len(x) for x in want] and np.concatenate(got).tolist() == [y for x in want for y in x]


def test_elias_fano():
    r = np.random.Generator(np.random.PCG64(1))
    for n, u in ((0, 1), (1, 1), (7, 3), (50, 10**9), (1000, 2000), (3000, 40), (2048, 10**6)):
        v = np.sort(r.integers(0, u, n))
        ef = tokens.EliasFano.encode(v)
        assert [x for k in range(len(ef.marks)) for x in ef.stretch(k).tolist()] == v.tolist()
        assert all(ef.select(i) == v[i] for i in range(0, n, 97))
        assert 8 * (len(ef.low) + len(ef.high)) + 32 * len(ef.marks) <= n * (2 + max(0, np.log2(max(u, 1) / max(n, 1))) + 1) + 64


def brute_cover(seqs, window):
    seen = collections.Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        g = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                g[i : i + window] = True
        out.append(g)
    return out


def test_suffix_arrays():
    r = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        t = r.integers(97, 97 + r.integers(1, 5), r.integers(0, 40)).astype(np.uint8)
        raw = t.tobytes()
        sa = suffixes.two_stage(t, 64)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for most in (1, 7, 8, 20):
            want = [next((k for k in range(most) if raw[i + k : i + k + 1] != raw[j + k : j + k + 1] or max(i, j) + k >= len(raw)), most) for i, j in zip(sa[:-1].tolist(), sa[1:].tolist())]
            assert len(t) == 0 or suffixes.common_prefixes(t, sa, most).tolist() == want


@pytest.mark.parametrize("most", [512, 1])
def test_bytes(spark, docs, texts, empty, most):
    w, k = 60, 16
    d = repeats.rows(docs)
    f = repeats.flagged(d, "bytes", w, k)
    whole = f.where("whole").select("rid", F.col("a").alias("s"), (F.col("a") + F.col("m") - 1 + w).alias("e"))
    spans = whole.unionByName(suffixes.resolve(d, w, k, f.where("probe").select("rid", "gram", "a", "m", "whole", "rivals"), most, 8))
    got = repeats.finish(d, spans, suffixes.RESULT, suffixes.byte_digest)
    raw = [(t or "").encode() for _, t in texts]
    want = [(i, len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (i, _), b, g in zip(texts, raw, brute_cover(raw, w))]
    same([tuple(r) for r in got.collect()], want)
    assert suffixes.remove(empty).count() == 0


def test_words(spark, docs, texts, empty):
    got = debruijn.remove(docs, window=12, k=5)
    seqs = [words(t) for _, t in texts]
    want = [(i, len(s), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(" ".join(x for x, y in zip(s, g) if not y).encode()).hexdigest()) for (i, _), s, g in zip(texts, seqs, brute_cover(seqs, 12))]
    same([tuple(r) for r in got.collect()], want)
    assert debruijn.remove(empty).count() == 0


def test_words_of_one_hash(spark):
    """Spots that share a key by chance are told apart by their words."""
    d = repeats.rows(spark.createDataFrame([(1, "a b c d e"), (2, "a b c x y"), (3, "q a b c"), (4, "a b c")], "doc_id long, text string"))
    rid = {r["doc_id"]: r["rid"] for r in d.collect()}
    spots = [(1, 0, 3, 7, True), (2, 0, 3, 7, True), (3, 0, 3, 7, True), (3, 1, 4, 8, True), (4, 0, 3, 8, False), (1, 2, 5, 9, True), (2, 2, 5, 9, True)]
    spots = spark.createDataFrame([(rid[i], *x) for i, *x in spots], "rid long, s long, e long, key long, own boolean")
    same([tuple(r) for r in debruijn.verified(d, spots).collect()], [(rid[1], 0, 3), (rid[2], 0, 3), (rid[3], 1, 4)])
    # pieces 5 (twice, by chance) and 6: all of gram 1 are looked at window by window, gram 2 stays as it was
    f = spark.createDataFrame([(1, 1, 5, 0, 2, True, False), (2, 1, 5, 4, 2, True, True), (3, 1, 6, 0, 1, True, False), (4, 2, 9, 0, 3, False, True), (5, 2, 8, 0, 3, True, False)], "rid long, gram long, piece long, a long, m int, whole boolean, probe boolean")
    odd = spark.createDataFrame([(5,)], "piece long")
    same([tuple(r) for r in debruijn.taken_apart(f, odd).collect()], [(1, 0, 2, False), (2, 4, 2, False), (3, 0, 1, True), (4, 0, 3, False)])


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_set_join(spark, docs, texts, empty, k, num):
    sets = []
    for _, t in texts:
        w = [fold(x) for x in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), doc), doc)
    same([tuple(r) for r in setjoin.groups(docs, k, num, 100).collect()], [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(texts)])
    assert setjoin.groups(empty).count() == 0


def test_set_join_links(spark, docs, texts, empty):
    sets = []
    for _, t in texts:
        w = [fold(x) for x in words(t)]
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} if w else ()))
    linked = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    every = range(len(sets))
    want = [(texts[i][0], min(texts[j][0] for j in every if j == i or (sets[i] and sets[i] == sets[j])), sum(linked(i, j) for j in every if j != i)) for i in every]
    got = setjoin.join(docs, 4, 85, 100)
    same([(r.doc_id, r.class_id, r.n_links) for r in got.collect()], want)
    same(got.select("doc_id", "n_shingles", "component_id").collect(), setjoin.groups(docs, 4, 85, 100).collect())
    assert max(n for _, _, n in want) > 3 and setjoin.join(empty).count() == 0


def test_set_join_in_blocks(spark, docs):
    """Clusters dealt in many small blocks, and counts of sets that meet in several clusters, stay the same."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slots = setjoin.slots_for(10)
    seen = setjoin.survey(d, 4, slots).cache()
    every = seen.where("block is null").select("sid")
    freq = setjoin.frequencies(seen.where("block is not null").select("block", "salt", "counts"), slots)
    count = lambda **how: {r.sid: r.n for r in setjoin.links(d, every, freq, 4, 17, 20, **how).groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    assert count() == count(block_sets=3) == count(block_items=200) and max(count().values()) > 3


def test_set_join_answers():
    r = np.random.Generator(np.random.PCG64(8))
    for _ in range(40):
        base = r.integers(0, 1 << 60, r.integers(1, 90)).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[r.random(len(base)) < r.choice([0.5, 0.9, 1.0])], r.choice(base, 1), r.integers(0, 40, r.integers(0, 9)).astype(np.uint64)])) for _ in range(r.integers(1, 50))]
        want = [[100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)) for y in map(np.ndarray.tolist, sets)] for x in map(np.ndarray.tolist, sets)]
        for room in (1 << 21, 1):
            got = setjoin.linked(sets, int(r.integers(0, len(sets))), 80, 100, room)
            np.fill_diagonal(got, True)
            assert got.tolist() == want
        owner, elem = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        got, want = setjoin.in_common(owner, elem, len(sets), 3), [[len(set(x) & set(y)) for y in map(np.ndarray.tolist, sets)] for x in map(np.ndarray.tolist, sets)]
        assert ((got == want) | np.eye(len(sets), dtype=bool)).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}


def test_quality(spark, docs, texts, empty):
    got = quality.judge(docs).collect()
    want = []
    for i, t in texts:
        w, t = words(t), t or ""
        g = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for p in range(len(w) - 2) if g[tuple(w[p : p + 3])] > 1 for j in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert not any(r.kept and r.base_failed for r in got) and all(0 <= r.posterior <= 1 for r in got)
    assert quality.judge(empty).count() == 0


def brute_em(patterns, rounds=60):
    """Posterior of each vote pattern by plain expectation-maximisation over (pattern, count)."""
    m, total = len(patterns[0][0]), sum(n for _, n in patterns)
    post = [1 / (1 + np.exp(-sum(0.5 if v > 0 else -2.5 if v < 0 else 0 for v in p))) for p, _ in patterns]
    for _ in range(rounds):
        mass = [sum(q * n for q, (_, n) in zip(post, patterns))]
        mass.append(total - mass[0])
        prior = min(max(mass[0] / total, 0.01), 0.99)
        table = [[{v: 0.5 for v in (-1, 0, 1)} for _ in range(m)] for _ in range(2)]
        for q, (p, n) in zip(post, patterns):
            for j, v in enumerate(p):
                table[0][j][v] += q * n
                table[1][j][v] += (1 - q) * n
        post = []
        for p, _ in patterns:
            good, bad = prior, 1 - prior
            for j, v in enumerate(p):
                good *= table[0][j][v] / (mass[0] + 1.5)
                bad *= table[1][j][v] / (mass[1] + 1.5)
            post.append(good / (good + bad))
    return {p: q for q, (p, _) in zip(post, patterns)}


def test_quality_posterior(spark):
    """The posterior is that of a plain EM over the same votes, and agrees with the labels that some documents have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    votes = {r.doc_id: (tuple(r._v), r.n_words) for r in quality.votes(quality.signals(docs)).select("doc_id", "_v", "n_words").collect()}
    want = brute_em(sorted(collections.Counter(v for v, n in votes.values() if n).items()))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(abs(got[i].posterior - want[v]) < 1e-6 for i, (v, n) in votes.items() if n)
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    firm = [(q, g.posterior >= 0.5) for q, g in labels if not g.base_failed]
    assert np.mean([bool(q) == k for q, k in firm]) > 0.97 and np.mean([k for q, k in firm if q]) > 0.98


def test_mixing(spark, docs, texts, empty):
    got = mixing.taken(docs).collect()
    same([(r.doc_id, r["size"]) for r in got], [(i, len(words(t))) for i, t in texts])
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    per = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        p = per[r.source]
        p[0], p[1], p[2], p[3] = p[0] + r["size"], p[1] + r.taken, r.target, max(p[3], r["size"])
    total = sum(p[0] for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6 * total and sum(p[1] for p in per.values()) <= total
    assert all(abs(p[1] - p[2]) <= p[3] and p[2] <= 3 * p[0] + 1e-9 for p in per.values())
    same([tuple(r) for r in mixing.taken(docs.repartition(5)).collect()], [tuple(r) for r in got])
    assert mixing.taken(empty).count() == 0


def brute_mix(rows, seed=7):
    """Words taken of each (doc_id, source, size), by the rule alone: rows have distinct ids."""
    per = collections.defaultdict(int)
    for _, s, z in rows:
        per[s] += z
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(per.values()), set()
    while True:
        level = (total - sum(3 * per[s] for s in full)) / (sum(w for s, w in weight.items() if s not in full) or 1)
        more = {s for s in order if s not in full and weight[s] * level >= 3 * per[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * per[s] if s in full else weight[s] * level for s in order}
    entries = []
    for s in order:
        queue = sorted((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16), i, z) for i, o, z in rows if o == s)
        at = 0
        for p in range(3):
            for _, i, z in queue:
                at += z
                if z:
                    entries.append([at / target[s], s, i, p, z])
    for s in order:
        own = [e for e in entries if e[1] == s]
        room = target[s] - sum(e[4] for e in own if e[0] <= 1)
        late = [e for e in own if e[0] > 1]
        while True:
            fits, run, got = [e for e in late if e[4] <= room], 0, []
            for e in fits:
                run += e[4]
                if run > room:
                    break
                got.append(e)
            if not got:
                break
            room -= sum(e[4] for e in got)
            late = [e for e in late if e not in got]
            for e in got:
                e[0] = 1.0
    left, out = total, collections.Counter()
    key = lambda e: (e[0], "n" if e[1] is None else "s" + e[1], e[2], e[3])
    for e in sorted((e for e in entries if e[0] <= 1 or e[0] - e[4] / target[e[1]] < 1), key=key):
        if e[4] > left:
            break
        left -= e[4]
        out[e[2]] += e[4]
    return target, out


def test_mixing_by_brute_force(spark):
    r = random.Random(9)
    rows = [(i, None if i % 13 == 0 else f"s{min(r.randrange(6), r.randrange(6))}", r.choice([0, 1, 5, 30, 200, 900]) + r.randrange(9)) for i in range(260)] + [(999, "tiny", 3)]
    d = spark.createDataFrame([(i, s, "w " * z) for i, s, z in rows], "doc_id long, source string, text string")
    target, want = brute_mix(rows)
    got = mixing.taken(d).collect()
    assert {r.doc_id: r.taken for r in got} == {i: want[i] for i, _, _ in rows}
    assert all(abs(r.target - target[r.source]) < 1e-6 * r.target for r in got)
    mixed = mixing.mixture(d).collect()
    sums = collections.Counter()
    for x in mixed:
        sums[x.doc_id] += x["size"]
    assert sums == +want and [x.finish for x in mixed] == sorted(x.finish for x in mixed)


def test_language(spark, empty):
    r = random.Random(4)
    stock = {"aa": "kal mor tus", "bb": "xyn quor fix", "cc": "öla üben ßer"}
    rows = [(i, " ".join(r.choice(stock[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(r.choices(list(stock), k=200))]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "kal mor", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(d).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:200]) and got[902].lang_pred == "aa"
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= x.score <= 1 for x in got.values())
    assert langid.identify(empty.select("doc_id", "text", "lang")).count() == 0


def test_language_of_repeats_long_texts_and_many_labels(spark):
    r = random.Random(6)
    langs = [f"l{i:02d}" for i in range(12)]
    stock = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for x in langs}
    rows = [(i, " ".join(r.choice(stock[x]) for _ in range(40)), x, "lang_pred", 1.0) for i, x in enumerate(langs * 12)]
    rows += [rows[5], (901, " ".join(r.choice(stock["l03"]) for _ in range(60_000)), None, "x", 0.0), (902, "", "l01", None, None)]
    # source and score clash with names of the result or are not to be read
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = collections.defaultdict(list)
    for x in langid.identify(d).collect():
        got[x.doc_id].append(x)
    assert len(got[5]) == 2 and got[5][0] == got[5][1] and sum(map(len, got.values())) == len(rows)
    assert got[901][0].lang_pred == "l03" and got[902][0].lang_pred == "und"
    assert np.mean([got[i][0].lang_pred == x for i, _, x, *_ in rows[:144]]) > 0.95


def test_codewords():
    for n in (2, 3, 4, 6, 7, 20):
        m = langid.codewords(n)
        assert len({tuple(r) for r in m}) == n


def test_decontamination(spark, empty):
    items = [(1, "Which train leaves 35 km from the old station before the 7 hours of rest that Maria took there"), (2, "short one here"), (3, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "noise words first. " + items[0][1] + " and more noise"),
        (2, "some say: which train leaves 99 km from the old station before the 4 hours of rest that Petra took there"),
        (3, "which train leaves the old station"), (4, None), (5, ""), (6, "which TRAIN leaves, 35 km from the old station before the road"),
    ]
    got = {r.doc_id: r for r in decontaminate.judge(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2} and len(got) == 6
    assert list(got[1].item_ids) == [1] and list(got[1].reworded_ids) == [] and list(got[2].reworded_ids) == [1]
    assert decontaminate.judge(empty, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.judge(spark.createDataFrame(rows, "doc_id long, text string"), b.where("false")).collect())


def test_decontamination_of_slot_dense_and_short_items(spark):
    items = [
        (1, "12 pens at 3 dollars 15 pads at 4 dollars 7"), (2, "short one here"), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (4, "Which train leaves the old station first"),
        (5, "Alice has 5 red apples and gives them away"), (6, "4 8 15 16 23 42 31 37 11 2 19 old clocks were sold there"), (7, "he saw how Maria took the old road"),
    ]
    want = {
        "we sold 12 pens at 3 dollars 15 pads at 4 dollars 7 of them": [1], "we sold 20 pens at 5 dollars 11 pads at 6 dollars 9 of them": [1], "we sold 20 pens at 5 dollars 20 pads at 5 dollars 9 of them": [],
        "a SHORT one, here": [2], "short one there": [], "so 1 2 3 4 5 6 7 8 9 10 11 12 13 it goes": [3], "so 1 2 3 4 5 6 7 8 9 10 11 12 14 it goes": [],
        "they asked Which train leaves the old station first": [4], "Now. Which train leaves the old station first": [4], "they asked which train leaves the old station first": [4],
        "we know Petra has 7 red apples and gives them away": [5], "Petra has 7 red apples and gives them away": [5], "there 1 2 3 6 7 8 9 20 21 22 5 old clocks were sold there": [6], "there 5 old clocks were sold there": [],
        "he saw how Petra took the old road": [7], "he saw how they took the old road": [],
    }
    rows = list(enumerate(want))
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want


def test_decontamination_recall_by_share_of_slots(spark):
    """Items of 3 to 24 words, none to all of them numbers: every verbatim copy is found, and nothing in texts without one."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    items, rows = [], []
    for i in range(120):
        n, share = r.randint(3, 24), (i % 6) / 5
        items.append((i, " ".join(str(r.randint(100, 99_999)) if r.random() < share else word() for _ in range(n)), "x"))
    for i, t, _ in items:
        rows.append((i, " ".join(word() for _ in range(r.randint(0, 40))) + ". " + t + " " + " ".join(word() for _ in range(r.randint(0, 40))), "rid", 1))
        rows.append((1000 + i, " ".join(word() for _ in range(80)), "rid", 2))
    rows += [rows[0], (2000, " ".join(word() for _ in range(20_000)) + " " + items[7][1], None, 3)]
    # rid and w clash with names the operator uses itself; item and document tables share a column
    d = spark.createDataFrame(rows, "doc_id long, text string, rid string, w int")
    got = decontaminate.judge(d, spark.createDataFrame(items, "item_id long, text string, rid string")).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: list(x.item_ids) for x in got}
    assert all(i in by[i] for i in range(120)) and not any(by[1000 + i] for i in range(120)) and 7 in by[2000]


def test_preference_of_long_and_empty(spark):
    long = "x" * 200_000
    rows = [(0, 0, "user", long, "p"), (0, 1, "assistant", "a", "p"), (1, 0, "user", long, "p"), (1, 1, "assistant", "b" * 100_000, "p"), (1, 1, "assistant", "b" * 100_000, "p")]
    # chosen and prompt clash with names of the result
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prompt string, chosen int")
    (got,) = preference.format_pairs(preference.pair_up(d)).collect()
    assert got.n_common == 1 and len(got.prompt) == 200_000 + len("<|im_start|>user\n<|im_end|>\n") and got.rejected_text.count("b") == 200_000 and len(got.rejected_mask) == 2
    assert preference.digest(preference.format_pairs(preference.pair_up(d.where("false")))).count() == 0


def test_preference(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B"), (1, 2, "user", None), (3, 0, None, "x"), (4, 0, "user", "q"), (5, 0, "user", "q"), (None, 0, "user", "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preference.format_pairs(preference.pair_up(d)).collect()}
    p = got[0]
    assert (p.n_common, p.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n") and p.chosen_text == "<|im_start|>assistant\nA<|im_end|>\n"
    assert [p.chosen_text[s.start : s.end] for s in p.chosen_mask] == ["A<|im_end|>"] and p.rejected_text.endswith("<|im_start|>user\n<|im_end|>\n")
    assert got[1].chosen_id is None and got[1].n_common == 0 and (got[2].n_common, got[2].chosen_text, got[2].rejected_text) == (1, "", "")
    assert sorted(got) == [0, 1, 2]


def test_warc(spark):
    big = "é" * 700
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c", "x"), (4, None, "x"), (5, "http://d", None), (6, "http://e", "y\r\n\r\nWARC/1.1" * 200), (9, "http://a", big), (10, "http://f", ""), (11, "http://g", "z" * 999), (12, "http://h", "z" * 999)]
    # digest, bytes and offset clash with names the operator uses itself
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, digest string, bytes int, offset int")
    to = shared.folder(spark, "warc")
    index = warc.write(warc.decide(d), to, frame_bytes=2000)
    got = {r.page_id: r for r in warc.read(spark, to).collect()}
    assert len(got) == len(rows)
    for i, url, h in rows:
        raw, twin = (h or "").encode(), i in (1, 2)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(raw), hashlib.sha1(raw).hexdigest(), url)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if twin else ("response", None))
        assert got[i].payload == (None if twin else raw)
    for r in index.collect():
        head, payload = warc.fetch(to, r.asDict())
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and head["WARC-Date"] and (payload == (got[r.page_id].payload or b""))
    none = shared.folder(spark, "warc")
    assert warc.write(warc.decide(d.where("false")), none).count() == 0 and warc.read(spark, none).count() == 0


def test_warc_repeated_rows(spark):
    d = spark.createDataFrame([(7, "http://a", "v" * 2000), (7, "http://a", "v" * 2000), (3, "http://b", "v" * 2000), (None, None, "v" * 2000)], "page_id long, url string, html string")
    to = shared.folder(spark, "warc")
    warc.write(warc.decide(d), to)
    same([(r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, to).collect()], [(7, "response", None), (7, "response", None), (3, "revisit", 7), (None, "response", None)])


def test_textkit():
    r = np.random.Generator(np.random.PCG64(5))
    for w in (1, 2, 7, 24):
        for n in (0, 1, 24, 100):
            h = r.integers(0, 9, n).astype(np.uint64)
            assert textkit.window_min(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(max(0, n - w + 1))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_how_crowded_grams_are_cut_changes_nothing(spark, sf):
    """Everything by suffix arrays, and everything that can be cut into parts and windows, over whole tables."""
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    few, many = (sorted(map(tuple, suffixes.remove(d, most_rivals=m).collect())) for m in (2, 10**9))
    assert few == many and sum(x[2] > 0 for x in few) > 5


def test_equal_hashes_of_unlike_bytes_are_told_apart(spark):
    """Spots with one key and other bytes, as if their hashes had met, do not count as repeats."""
    a, b = "abcd" * 200, "wxyz" * 200
    d = repeats.rows(spark.createDataFrame([(1, a), (2, b), (3, "--" + b)], "doc_id long, text string"))
    rid = {r.doc_id: r.rid for r in d.collect()}
    spots = shared.cut(spark.createDataFrame([(rid[1], 0, 400, 7, True), (rid[2], 0, 400, 7, True), (rid[3], 2, 402, 7, True)], "rid long, s long, e long, key long, own boolean"), "spots")
    assert sorted(map(tuple, debruijn.verified(d, spots, "bytes").collect())) == sorted([(rid[2], 0, 400), (rid[3], 2, 402)])


def test_bundles_written_twice_agree_with_either_index(spark, tmp_path):
    """A second attempt that gets its rows in another order writes the same files."""
    pages = spark.createDataFrame([(i % 40, f"http://a/{i % 3}" if i % 5 else None, None if i % 9 == 0 else f"<p>{i % 7}</p>" * (200 if i % 2 else 3)) for i in range(160)], "page_id long, url string, html string")
    to = f"file://{tmp_path}/warc"
    decided = warc.decide(pages).repartition(3, "page_id")
    first = warc.write(decided, to, frame_bytes=2000, bundle_bytes=9000)
    again = warc.write(decided.repartition(11).repartition(3, "page_id"), to, frame_bytes=2000, bundle_bytes=9000)
    rows = sorted(map(repr, first.collect()))
    assert rows == sorted(map(repr, again.collect())) and len(rows) == 160
    for r in first.collect():
        head, _ = warc.fetch(to, r.asDict())
        assert head["WARC-Record-ID"][10:-1] == str(r.page_id)


def test_packed_counts():
    r = np.random.Generator(np.random.PCG64(1))
    for top, share in ((200, 1.0), (200, 0.01), (70000, 0.001), (300, 0.5), (2**32 - 1, 1.0)):
        x = r.integers(1, top, setjoin.BLOCK) * (r.random(setjoin.BLOCK) < share)
        out = np.zeros(setjoin.BLOCK, np.int64)
        at, n = setjoin.unpacked(setjoin.packed(x))
        out[at] = n
        assert (out == x).all()
    assert len(setjoin.packed(np.eye(1, setjoin.BLOCK, 5, dtype=np.int64)[0])) == 4


def test_folders_are_released(spark):
    begun = shared.mark()
    a, b = (shared.cut(spark.range(3), "x") for _ in "ab")
    shared.release(begun, b)
    assert b.count() == 3
    with pytest.raises(Exception):
        a.count()
    shared.drop(b)
