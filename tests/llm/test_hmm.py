import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import hmm


def tiny(states=3, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((hmm.SYMBOLS, states)), 0))


def brute(seq, m):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
    return math.log(total)


def test_forward_sums_over_all_paths():
    m = tiny()
    seqs = [np.array(s) for s in ([0], [5, 0], [5, 9, 0], [7, 7, 7, 0], [1, 2, 3, 4, 0])]
    assert np.allclose(hmm.forward(seqs, m)[0], [brute(s, m) for s in seqs])


def test_counts_and_climbing():
    rng = np.random.default_rng(1)
    seqs = sorted((np.append(rng.integers(1, 30, rng.integers(0, 30)), 0) for _ in range(40)), key=len)
    m, before = tiny(), -np.inf
    for _ in range(4):
        counts, moves, starts = np.zeros((hmm.SYMBOLS, 3)), np.zeros((3, 3)), np.zeros(3)
        like = hmm.expected(seqs, m, counts, moves, starts)
        assert np.isclose(counts.sum(), sum(map(len, seqs))) and np.isclose(starts.sum(), len(seqs)) and np.isclose(moves.sum(), sum(len(s) - 1 for s in seqs))
        assert like > before - 2
        before, m = like, hmm.maximise(counts, moves, starts)
        assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_base_score_and_edges(spark):
    rows = [(i, ("the cat Sat on THE mat " * (i % 4) + f"w{i} W{i}").strip()) for i in range(60)] + [(100, None), (101, ""), (102, "İé é\tx\x0bx"), (200, "the cat"), (200, "the cat"), (103, "a " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    got = hmm.score(df, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows)
    words = lambda t: [*hmm.words_of(t), None]
    c = Counter(w for i, t in rows if i % 5 for w in words(t))
    n, v = sum(c.values()), len(c)
    texts = {}
    for i, t in rows:
        texts[i] = t
    for r in got:
        w = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    assert hmm.score(df.limit(0), F.lit(True)).count() == 0
    assert all(r["train_tokens"] == 0 for r in hmm.score(df.limit(5), F.lit(False)).collect())


def test_long_sequences_in_pieces():
    rng, m = np.random.default_rng(4), tiny()
    for n in (1, 2, 37, 40):
        seq = rng.integers(0, 50, n)
        whole = [np.zeros((hmm.SYMBOLS, 3)), np.zeros((3, 3)), np.zeros(3)]
        pieces = [np.zeros_like(x) for x in whole]
        assert np.isclose(hmm.expected([seq], m, *whole), hmm.expected_long(seq, m, *pieces, piece=10))
        assert all(np.allclose(a, b) for a, b in zip(whole, pieces))


def test_score_is_the_likelihood_by_brute_force(spark, monkeypatch):
    """Each word's symbol by hand, the forward sum over all paths, and the add-one shares within classes."""
    monkeypatch.setattr(hmm, "PASSES", 0)
    rows = [(1, "a b a"), (2, "b c"), (3, None), (4, "a zz")]
    seen = []
    real = hmm.first_guess
    monkeypatch.setattr(hmm, "first_guess", lambda seqs: seen.append(real(seqs)) or seen[-1])
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 4).collect()}
    place = {"a": 1, "b": 2, "c": 3}  # by count and then by bytes
    unseen = 1 + hmm.OWN + hmm.class_of(b"zz")
    for i, text in rows:
        symbols = [place.get(w, unseen) for w in (text or "").split()] + [0]
        assert math.isclose(got[i], brute(symbols, seen[0]) / math.log(10) + 0.0 * len(symbols), rel_tol=1e-9)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, n_tokens int, Score int, row int")
    row = hmm.score(df, F.lit(True)).first()
    assert row.asDict().keys() == {"doc_id", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score"} and row["row"] == 7 and row["n_tokens"] == 2
