"""Two tokenizers' alignment against a plain count over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import align, queries, textkit

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def plain_tokens(both, text):
    a, b = both
    if not text:
        return [], []
    x = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def ends(tokens):
    return np.cumsum([len(t) for _, t in tokens]).tolist()


def plain(both, rows):
    per, count = [], collections.Counter()
    for doc_id, text in rows:
        x, y = plain_tokens(both, text)
        at_x, at_y = dict(zip(ends(x), range(len(x)))), dict(zip(ends(y), range(len(y))))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(at_x.keys() & at_y.keys()):
            groups.append(",".join(str(t) for t, _ in x[i : at_x[e] + 1]) + "|" + ",".join(str(t) for t, _ in y[j : at_y[e] + 1]))
            links.append((y[at_y[e]][0], x[at_x[e]][0]))
            i, j = at_x[e] + 1, at_y[e] + 1
        count.update(links)
        per.append((doc_id, len(x), len(y), groups, links))
    most = collections.Counter()
    for (b, _), n in count.items():
        most[b] = max(most[b], n)
    return [
        (d, x, y, len(g), len(k), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, x, y, g, k in per
    ], {(b, a, n, n == most[b]) for (b, a), n in count.items()}


ODD = [
    None, "", " ", "   ", "a", " lead", "trail ", "two  spaces   and\ttabs\n\nlines", "x▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve ﬁ ① ½",
    "\U0001f600\U0001f469‍\U0001f680 你好世界 да", "\x00\x01 nul", "a b　c  d\x85e", "don't we'll I'M it's", "1234567 3.14 1,000", "A" * 5000, "word " * 3000, "    indented(code) {\n\treturn x;\n}",
]


def rows():
    r = random.Random(4)
    vocab = "the of Haus müde tzäh réeux niño x y2k don't (a) end. foo_bar ßß".split()
    return [*enumerate(ODD), *((100 + i, "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\n", "", ", "]) for _ in range(r.randint(1, 200)))) for i in range(60)), (100, "again again"), (None, "no id"), (101, "again again")]


@pytest.mark.parametrize("sizes", [{}, {"spill_records": 50, "spill_docs": 3, "split_bytes": 200}])
def test_against_plain_count(spark, both, sizes):
    # chunk, radix and n_a clash with names that the operator uses itself
    docs = spark.createDataFrame([(*x, 1, 2, "n") for x in rows()], "doc_id long, text string, chunk int, radix int, n_a string")
    got, pairs = align.align(docs, A, B, **sizes)
    want, want_pairs = plain(both, rows())
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert {tuple(x) for x in pairs.collect()} == want_pairs
    assert sum(x[1] > 0 for x in want) > 60


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got, pairs = align.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == 0 and pairs.count() == 0
    nothing = align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)[0]
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def encoded(kind, path, texts):
    s = next(textkit.slices(pa.array([" " + t for t in texts]), 1 << 30))
    ids, n = align._tokenizer(kind, path).encode(s)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\nabé'.,1_<|> "), st.characters(exclude_categories=["Cs"], exclude_characters="▁")), min_size=1, max_size=40), min_size=1, max_size=4))
def test_ids_are_those_of_whole_texts(both, texts):
    a, b = both
    assert encoded(align.ByteTokens, A, texts) == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert encoded(align.PieceTokens, B, texts) == [b.encode(t) for t in texts]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ids_over_whole_tables(spark, both, sf):
    a, b = both
    texts = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect() if r.text]
    assert encoded(align.PieceTokens, B, texts) == b.encode(texts)
    if sf == "sf0.001":
        assert encoded(align.ByteTokens, A, texts) == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_query_on_the_small_table(spark, both):
    sf = "/root/testdata/sf0.001"
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, queries.QUERIES["op13_token_alignment"](spark, sf).collect())) == collections.Counter(plain(both, source)[0])


def test_merge():
    r = np.random.Generator(np.random.PCG64(1))
    runs, want = [], collections.Counter()
    for _ in range(9):
        p = np.unique(r.integers(0, 40, r.integers(0, 30)))
        n = r.integers(1, 9, len(p))
        runs.append((p, n))
        want.update(dict(zip(p.tolist(), n.tolist())))
    assert list(align.merge(runs)) == sorted(want.items())
