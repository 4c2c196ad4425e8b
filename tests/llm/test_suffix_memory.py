"""Memory of a suffix array's build."""

import random
import tracemalloc

import numpy as np

from marlstone.llm import suffixes


def test_keys_of_one_bucket_at_a_time():
    r = random.Random(1)
    raw = bytes(r.choices(range(1, 200), k=60_000)) + b"\0" + bytes(r.choices(b"ab", k=500)) * 3 + b"\0"
    t = np.frombuffer(raw, np.uint8)
    tracemalloc.start()
    sa = suffixes.two_stage(t, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    prefixes = [raw[i : i + 400] for i in sa.tolist()]
    assert sorted(sa.tolist()) == list(range(len(raw))) and all(a <= b for a, b in zip(prefixes, prefixes[1:]))
    assert peak < 10e6  # half of the suffixes are sorted: their keys together are over 12 MB
