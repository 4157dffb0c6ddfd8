import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import mixing


def brute_targets(sizes):
    """Water filling by hand: sources in order, weights 5, 2, 1, at most three times each size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in left) if left else 0
        over = {s for s in left if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.floats(0, 1))
def test_fit_is_as_near_as_can_be(items, share):
    lengths, counts = np.array(list(items)), np.array(list(items.values()))
    total = int((lengths * counts).sum())
    budget = int(total * share)
    take = mixing.fit_counts(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    reach = {0}
    for a, n in items.items():
        reach = {r + a * k for r in reach for k in range(n + 1)}
    best = min(abs(r - budget) for r in reach)
    assert abs(int((take * lengths).sum()) - budget) <= max(best, lengths.max())


def rows_of(n):
    sources = ["b", "a", None, "c", "", "é"]
    return [(i, sources[0] if i % 3 == 0 else sources[i % 6], " ".join(["w"] * (i * 7 % 40))) for i in range(n)]


def test_targets_and_taken(spark):
    rows = rows_of(300) + [(7, "a", "w w w")] * 3 + [(1000, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' as size")
    got = mixing.mix(df).collect()
    again = sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert sorted(map(str, got)) == again and len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        of = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in of} == {sizes[s]} and abs(of[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["size"] * r["copies"] for r in of) - want[s]) <= 1 or want[s] < 3
    assert all(0 <= r["copies"] <= 3 for r in got)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a", "w " * 200_000, "x", "y"), (2, "a", "w", "x", "y")], "doc_id long, source string, text string, source_key string, in_0 string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["size"] == 200_000 and (got[2]["source_key"], got[2]["in_0"], got[2]["source_size"]) == ("x", "y", 200_001)
