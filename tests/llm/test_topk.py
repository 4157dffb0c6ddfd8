import numpy as np

from pagewright.llm import topk


def brute(rows, ids, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append(np.floor(256 * np.float64(np.float32(v))).astype(np.int64))
    out = []
    for q in sorted(set(ids) & set(ok)):
        s = sorted((-int(v @ ok[q][0]), i) for i, vs in ok.items() if i != q for v in vs if len(v) == len(ok[q][0]))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 0.3, 8) if i % 5 else np.ones(8) * 0.25).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700, None), (750, [None] * 8), (800, [float("nan")] * 8), (850, [float("inf")] + [0.0] * 7), (900, [0.0] * 8), (950, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5))


def test_stops_on_proof_alone():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (3000, 16))
    v[:200] = rng.integers(-250, 250, 16)  # many rows of one score
    ids = rng.permutation(3000)
    index = topk.Index(ids, v)
    for q in (*v[:5], *v[500:520], np.zeros(16, dtype=int)):
        got, scores = index.search(int(ids[3]), q, 5)
        s = v @ q
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[3]][:5]
        assert got.tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()


def test_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK", 1100)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 90 if i == 5 else 0.3, 6).astype(np.float32).tolist()) for i in range(400)] + [(3, [0.5] * 6)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 10 = 0")).collect())
    assert got == sorted(brute(rows, [i for i in range(400) if i % 10 == 0], 5))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_reads_little_more_than_half_of_the_postings():
    v = np.random.default_rng(3).integers(-100, 100, (2000, 32))
    index = topk.Index(np.arange(2000), v)
    for i in range(50):
        got, scores = index.search(i, v[i], 5)
        s = v @ v[i]
        s[i] = -(10**9)
        assert scores.tolist() == np.sort(s)[:-6:-1].tolist()
    assert index.read < 0.6 * 50 * v.size  # with bounds by the highest impacts alone it was 0.95


def test_bars_and_odd_blocks():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, d, most = int(rng.integers(1, 200)), int(rng.integers(0, 9)), int(rng.choice([1, 200, 10**5, 2**30]))
        v = rng.integers(-most, most + 1, (n, d))
        v[rng.random(n) < rng.choice([0, 0.5])] = v[0]  # copies
        ids = rng.integers(0, n + 1, n)
        q, own, k = v[-1], int(ids[0]), int(rng.integers(1, 7))
        s = v @ q
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != own]
        for bar in (None, *(int(s[i]) for i in order[:: k + 1])):
            want = [i for i in order[:k] if bar is None or s[i] >= bar]
            got, scores = topk.Index(ids, v).search(own, q, k, bar)
            assert got.tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()


def test_blocks_after_the_first_keep_ties_with_the_bar(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 1100)
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(0, 0.3, 8) if i % 3 else np.ones(8) * 0.5).astype(np.float32).tolist()) for i in rng.permutation(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)  # several blocks in one task
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 200 = 0")).collect())
    assert got == sorted(brute(rows, range(0, 4000, 200), 5))
