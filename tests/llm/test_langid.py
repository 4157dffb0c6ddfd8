import random

import numpy as np

from pagewright.llm import langid

SYLLABLES = {"aa": "the ing th er on an".split(), "bb": "que de la os ción es".split(), "cc": "sch ein ich ung die tz".split()}


def text(rng, lang):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 30)))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ²³ --", "cc"), (1003, "the thing " * 20_000, None), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] % 5 == 0 and r["doc_id"] < 400]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] == "aa"
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}


def test_backs_off_to_shorter_grams():
    grams = {"4^abc": 0, "2^a": 1, "1z": 2}
    rates = np.array([[-1.0, -2], [-3, -1], [-5, -9]], dtype=np.float32)
    m = langid.Model(["x", "y"], {}, np.zeros((0, 2)), grams, rates, np.zeros(2))
    assert m.unseen("abcd").tolist() == [-1, -2] and m.unseen("ax").tolist() == [-3, -1] and m.unseen("qz").tolist() == [-5, -9] and m.unseen("q").tolist() == [0, 0]


def test_rows_are_kept_when_the_table_is_full():
    m = langid.Model(["x", "y"], {}, np.zeros((0, 2)), {"1a": 0, "1b": 1}, np.array([[-1.0, -2], [-3, -1]], dtype=np.float32), np.zeros(2))
    small, large = np.zeros((3, 2)), np.zeros((50, 2))
    t = "a b aa bb ab ba aab abb"
    assert m.predict(t, {}, small, [0]) == m.predict(t, {}, large, [0])


def test_words_and_grams_beyond_the_bounds_count_as_seen(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]] + [(300, None, "aa"), (301, "123", "bb"), (302, "zzz qqq", None), (303, "the " * 5_000 + "Osque", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = docs.where("doc_id % 3 <> 0")
    whole = langid.fit(learned)
    want = {r["doc_id"]: r for r in langid.predict(docs, whole).collect()}
    monkeypatch.setattr(langid, "MAX_WORDS", 5)
    monkeypatch.setattr(langid, "MAX_GRAMS", 5)
    model = langid.fit(learned)
    for words, hits, n_rows in ((60_000, 1_000_000, 20_000), (7, 1_000_000, 20_000), (60_000, 3, 20_000), (60_000, 1_000_000, 4)):
        monkeypatch.setattr(langid, "CHUNK_WORDS", words)
        monkeypatch.setattr(langid, "CHUNK_HITS", hits)
        monkeypatch.setattr(langid, "CHUNK_ROWS", n_rows)
        got = langid.predict(docs, model).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["lang_pred"] == want[r["doc_id"]]["lang_pred"] and np.isclose(r["score"], want[r["doc_id"]]["score"], atol=1e-9)
    assert langid.predict(docs.limit(0), model).count() == 0
