from collections import Counter

import pytest

from pagewright.functions import text as T
from pagewright.operators import beside, compare
from pagewright.plans import catalog, further
from pagewright.sources import columns, layout

LAYERS = {"b": (layout.words_b, columns.words_b), "c": (layout.words_c, columns.words_c), "d": (layout.words_d, columns.words_d), "e": (layout.words_e, columns.words_e)}
COLS = ["doc_id", "page", "line_ix", "word_ix", "ls", "text", "left", "top", "right", "bottom", "conf"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(-7, "one  two\tthree\n\n  four\n"), (1003, ""), (1004, None), (1005, "\n \n"), (1006, "\U0001d11e\U0001d11e éxtraordinary ﬁne ΟΔΟΣ ΟΔΟσ a.\r x"), (1011, "extraordinarily " * 700), (1012, "e " * 1300 + "\n" + "12345678\n" * 60), (None, "some words without a key")]
    return spark.createDataFrame(odd, "doc_id long, text string").union(layout.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")).repartition(3).cache()


def rows(df, cols=None):
    return Counter(tuple(r) for r in df.select(sorted(cols or df.columns)).collect())


@pytest.mark.parametrize("name", ["a", *LAYERS])
def test_layers_are_laid_out_alike(docs, name):
    flat, inside = LAYERS.get(name, (layout.words, lambda a: a))

    def work(ids, a):
        w = inside(a)
        yield {"doc_id": beside._ids(ids, w.row), "page": w.page, "line_ix": w.line, "word_ix": w.word, "text": w.text, **{c: getattr(w, c) for c in ("ls", "left", "top", "right", "bottom", "conf")}}

    schema = ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in COLS)
    known = docs.where("doc_id is not null")
    assert rows(columns.laid_out(known, work, schema)) == rows(flat(known), COLS)


@pytest.mark.parametrize("most", [beside.MOST, 7])
@pytest.mark.parametrize("name", LAYERS)
def test_comparisons_equal_those_of_tables(docs, name, most, monkeypatch):
    monkeypatch.setattr(beside, "MOST", most)
    if most == 7:
        docs = docs.where("doc_id is null or doc_id < 13 or doc_id > 1000")
    flat, inside = LAYERS[name]
    a, b = layout.words(docs), flat(docs)
    for by in (["doc_id"], ["doc_id", "page"], []):
        assert rows(beside.evaluate(docs, inside, by)) == rows(compare.evaluate(a, b, by)), by
    assert rows(beside.evaluate(docs, inside, ["doc_id"], T.loose_text)) == rows(compare.evaluate(a, b, ["doc_id"], T.loose(compare.F.col("a.text")) == T.loose(compare.F.col("b.text"))))
    assert rows(beside.assigned(docs, inside)) == rows(compare.assigned(a, b))
    assert rows(beside.k_to_one(docs, inside)) == rows(compare.k_to_one(a, b))


def test_votes_equal_those_of_tables(docs):
    flat, inside = ([x[i] for x in LAYERS.values()] for i in (0, 1))
    want = compare.consensus(layout.words(docs), [f(docs) for f in flat])
    assert rows(beside.consensus(docs, inside)) == rows(want)
    assert rows(beside.consensus_stats(docs, inside)) == rows(compare.consensus_stats(want))


@pytest.mark.parametrize("name", ["assigned_words", "eval_corpus", "eval_doc", "eval_doc_c", "eval_doc_d", "eval_doc_loose", "eval_page", "eval_page_c", "eval_page_d", "k_to_one_pairs_all", "consensus_stats", "consensus_words"])
def test_no_word_is_shuffled(spark, name):
    plan = (catalog.QUERIES | further.QUERIES if hasattr(further, "QUERIES") else catalog.QUERIES)[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Join" in x or "Window" in x]
    assert not moved and plan.count("Exchange") == (0 if "words" in name or "pairs" in name else 1)
