import random

import numpy as np

from pagewright.llm import ngram_join
from pagewright.llm.common import ASCII_LOWER


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().translate(ASCII_LOWER).split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    s = sets_of(rows)
    ends = list(range(len(rows)))

    def root(x):
        while ends[x] != x:
            x = ends[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(s[a] & s[b])
            if s[a] and s[b] and 100 * o >= 75 * len(s[a] | s[b]):
                ends[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(s[i]), min(groups[root(i)])) for i in range(len(rows)))


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token string")
    return sorted(map(tuple, ngram_join.join(df).collect()))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, "x " * 30_000), (907, "X " * 20_000), (908, "é 漢 ſ K k"), (909, "é 漢 ſ K K")]
    passage = [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(5, 80))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 3)])))
    base = [word() for _ in range(100)]
    for i in range(60):  # a chain: each next one is near the one before alone
        base = base[2:] + [word(), word()]
        rows.append((1000 + (i * 7) % 60, " ".join(base)))
    rows += [rows[5]] * 3
    assert got(spark, rows) == brute(rows)


def test_exactly_three_quarters(spark):
    words = [f"w{i}" for i in range(40)]
    rows = []
    for n, i in ((19, 1), (15, 2), (14, 3)):  # prefixes: 15, 11 and 10 shingles; 11 / 15 is below, 12 / 16 on the line
        rows.append((i, " ".join(words[:n])))
    rows += [(4, " ".join(words[20:40])), (5, " ".join(words[20:36]))]  # 16 and 12 shingles
    assert got(spark, rows) == brute(rows)
    assert dict((i, c) for i, _, c in got(spark, rows))[5] == 4


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 1)]


def test_mixing_keeps_numbers_apart():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(ngram_join.mixed(x))) == len(x)


def test_large_classes_and_heads(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words)) for i in range(50, 80)] + [(2, " ".join(words[:29])), (None, "all alone here"), (3, "x y")] + [(None, "no key at all")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda r: tuple((x is not None, x) for x in r)
    got_ = sorted((tuple(r) for r in ngram_join.join(df).collect()), key=order)
    want = [(i, 26, 2) for i in range(50, 80)] + [(2, 25, 2), (None, 1, None), (3, 1, 3)] + [(None, 1, None)] * 7
    assert got_ == sorted(want, key=order)


def test_linked_sets_have_heads_that_meet():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 400):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in range(0, n // 4 + 1, max(1, n // 8)):
            b = np.unique(np.concatenate([a[: len(a) - cut], rng.integers(0, 2**63, cut // 8).astype(np.uint64)]))
            if len(b) and ngram_join.linked(a, b):
                assert all(np.isin(ngram_join.head(a, o), ngram_join.head(b, o)).any() for o in ngram_join.ORDERS)
