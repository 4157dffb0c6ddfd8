import random

import numpy as np

from pagewright.llm import quality


def good(rng):
    return ". ".join(" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(2, 9))) + "."


def junk(rng):
    return " ".join("".join(rng.choices("ETAOIN", k=rng.randint(2, 8))) + rng.choice(["!!", "$$$", "###"]) for _ in range(rng.randint(10, 80)))


def data(spark, n=600):
    rng = random.Random(3)
    kinds = [rng.random() < 0.8 for _ in range(n)]
    docs = [(i, good(rng) if k else junk(rng)) for i, k in enumerate(kinds)]
    labels = [(i, int(k)) for i, k in enumerate(kinds) if i % 2 and k] + [(i, 0) for i, k in enumerate(kinds) if i % 2 and not k][:20] + [(None, 1), (5, None)]
    return kinds, spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    kinds, docs, labels = data(spark)
    for known in (labels, labels.where("quality = 1")):  # the second is told of positives alone
        model = quality.fit(docs.where("doc_id % 5 <> 0"), known.where("doc_id % 5 <> 0"))
        got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
        held = [i for i in got if i % 5 == 0]
        pos, neg = [got[i] for i in held if kinds[i]], [got[i] for i in held if not kinds[i]]
        assert np.mean([p > n for p in pos for n in neg]) > 0.98
        assert all(0 <= x <= 1 for x in got.values())


def test_the_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (40, 6)), rng.normal(0, 1, (70, 6))
    for prior, w in ((0.3, None), (0.95, 3.0)):  # the second makes the negative part negative
        at = [rng.normal(0, 1, (6, 5)), rng.normal(0, 1, 5), rng.normal(0, 1, 5), np.zeros(())]
        if w:
            at = [np.vstack([np.full((1, 5), w), np.zeros((5, 5))]), np.zeros(5), np.ones(5), np.full((), -2.0)]

        def part(x, n):
            value, grads = quality.negative_loss(at, x)
            return value / n, [g / n for g in grads]

        def whole():
            a, b = part(p, len(p))[0], part(u, len(u))[0]
            return prior * (1 - a), b - prior * a

        risk, grads = quality.nn_risk(part(p, len(p)), part(u, len(u)), prior)
        positive, negative = whole()
        assert (negative < 0) == bool(w) and abs(risk - (positive + max(0, negative))) < 1e-12
        for k, g in enumerate(grads):
            flat = at[k].reshape(-1) if at[k].shape else at[k].reshape(1)
            for i in range(0, flat.size, 3):
                old, ends = flat[i], []
                for step in (1e-6, -1e-6):
                    flat[i] = old + step
                    at[k] = flat.reshape(at[k].shape)
                    a, b = whole()
                    ends.append(a + b if not w else -b)
                flat[i] = old
                at[k] = flat.reshape(at[k].shape)
                assert abs((ends[0] - ends[1]) / 2e-6 - np.ravel(g)[i]) < 1e-5


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        margins = np.concatenate([rng.normal(3, 1, int(40_000 * prior)), rng.normal(-3, 1, int(40_000 * (1 - prior)))])
        bins = np.bincount(quality._bin(margins), minlength=quality.BINS).astype(float)
        assert abs(quality.prior_of(rng.normal(3, 1, 4000), bins) - prior) < 0.03


def test_every_unlabelled_row_counts(spark, monkeypatch):
    kinds, docs, labels = data(spark)
    monkeypatch.setattr(quality, "FIRST_UNLABELLED", 40)
    seen = []
    real = quality._summed
    monkeypatch.setattr(quality, "_summed", lambda rows, part: seen.append(rows.count()) or real(rows, part))
    assert quality.fit(docs, labels) is not None
    known = {r["doc_id"] for r in labels.where("quality is not null").collect()}
    assert seen == [len(kinds) - len(known - {None})] * len(seen) and len(seen) == 3 + quality.PASSES


def test_edges(spark):
    _, docs, labels = data(spark, 40)
    assert quality.fit(docs, labels.where("quality = 0")) is None
    assert quality.fit(docs.limit(0), labels) is None
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 3), (3, "x" * 100_000, 4), (None, "a b", 5)], "doc_id long, text string, pagewright_text int")
    assert [r["score"] for r in quality.score(odd, None).collect()] == [0.5] * 5
    model = quality.fit(docs, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and got[0]["score"] == got[1]["score"] == got[2]["score"] and [r["pagewright_text"] for r in got] == [1, 2, 3, 4, 5]
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.fit(docs, labels.unionByName(docs.selectExpr("doc_id", "1 as quality"))) is not None  # no row is unlabelled
