"""Counts of the quality rules against plain ones."""

import random
import re
import unicodedata
from collections import Counter

from marlstone.llm import quality

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(t):
    words = [w for w in re.split(f"[{SPACE}]+", t) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    kind = lambda c, k: unicodedata.category(c).startswith(k)
    return {
        "n_words": len(words), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_upper": sum(kind(c, "Lu") for c in t), "n_letters": sum(kind(c, "L") for c in t),
        "n_digits": sum(kind(c, "N") for c in t), "n_letterless": sum(not any(kind(c, "L") for c in w) for w in words), "n_repeat_words": len({i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}),
    }


def test_counts(spark):
    r = random.Random(3)
    texts = ["", "a", "a b c a b c", "-- 12 x- é² Ⅻ 数 𝔘 𐐀     ]^[ #", "a - \x0bB"] + ["".join(r.choice("aBé9Ⅻ数𐐀-#|]^\\ \n\t ") for _ in range(r.randrange(80))) for _ in range(200)]
    texts += [" ".join(r.choice(["a", "b", "7", "."]) for _ in range(r.randrange(40))) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = quality.signals(d)
    for row in s.collect():
        want = plain(texts[row.doc_id])
        assert {k: row[k] for k in want} == want, texts[row.doc_id]
    # no list of all letters, no sort by a lambda
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "regexp_extract_all(_t" not in "".join(x for x in plan.split(" AS ") if "{Lu}" in x or "{N}," in x)
