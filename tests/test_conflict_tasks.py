"""e5's counts are dealt by the number of facts, with the same result."""

from datetime import datetime

from marlstone.operators import evidence


def test_counts_dealt_by_facts(spark, monkeypatch):
    t = lambda d: datetime(2024, 1, d)
    rows = [(g, f"c{g}-{i}", ("x", "y", "x", "z")[i % 4], t(1 + i), None if i == 5 else t(4 + i)) for g in range(12) for i in range(6)]
    rows += [(0, "c0-0", "y", t(2), t(9)), (0, "c0-0", "z", t(2), t(9))]  # a chunk with several values never meets itself
    f = spark.createDataFrame(rows, "g int, chunk string, value string, valid_from timestamp, valid_to timestamp")

    def met(a, b):
        before = lambda x, y: x[3] < (y[4] or t(31))
        return a[1] != b[1] and a[2] != b[2] and before(a, b) and before(b, a)

    want = {g: sum(met(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] == g) for g in range(12)}
    for most in (5, 1000):
        monkeypatch.setattr(evidence, "FACTS_A_TASK", most)
        got = evidence.detect_conflicts(f, ["g"], "chunk")
        assert {int(r.g): r.n_pairs for r in got.collect()} == want
