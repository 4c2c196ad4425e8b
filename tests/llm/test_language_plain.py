"""Language codes against a plain decoder over a whole small table."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from marlstone.llm import langid, queries

SF = "/root/testdata/sf0.001"


def buckets(text):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode())
    return [(int.from_bytes(b[i : i + n], "big") * salt % 2**32) >> 18 for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)) for i in range(len(b) - n + 1)]


def test_query_against_a_plain_decoder(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    n = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and not held[i]:
            n[lang].update(buckets(text))
    langs, size = sorted(n), langid.BUCKETS
    code = langid.codewords(len(langs))
    share = {k: (lambda c, total: lambda g: (c[g] + 0.5) / (total + 0.5 * size))(n[k], sum(n[k].values())) for k in langs}

    def weight(bit, g):
        side = lambda sign: [share[k](g) for j, k in enumerate(langs) if code[j][bit] * sign > 0]
        plus, minus = side(1), side(-1)
        return math.log(sum(plus) / len(plus)) - math.log(sum(minus) / len(minus))

    known: dict = {}
    got = {r.doc_id: r for r in queries.QUERIES["op8_language_codes"](spark, SF).collect()}
    close = 0
    for i, text, _ in rows:
        r = got[i]
        assert r.held_out == held[i]
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        g = Counter(buckets(text))
        total = max(sum(g.values()), 1)
        for x in g:
            if x not in known:
                known[x] = [weight(b, x) for b in range(code.shape[1])]
        bits = [sum(known[x][b] * k for x, k in g.items()) / total for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-6.0 * s * c)) for s, c in zip(bits, word)) for word in code]
        p = [math.exp(min(loss) - x) for x in loss]
        top = max(p) / sum(p)
        assert r.score == pytest.approx(top, abs=1e-4)
        if sorted(loss)[1] - min(loss) > 1e-3:
            assert r.lang_pred == langs[loss.index(min(loss))]
            close += 1
    assert close > 150
