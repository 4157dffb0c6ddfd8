import pytest

from pagewright.operators import compare
from pagewright.sources import layout
from pagewright.sources.layout import table

SHAPE = "doc_id long, page long, line_ix long, word_ix long, text string, left long, top long, right long, bottom long, conf long"


def row(i, text, left, right, line=0):
    return (1, 0, line, i, text, left, 20 * line, right, 20 * line + 16, 50)


def brute(a, b):
    """The reference's rule, pair by pair (compareOCRModule.js:748-797)."""
    lines = lambda x: {k: sorted((r for r in x if (r["doc_id"], r["page"], r["line_ix"]) == k), key=lambda r: r["word_ix"]) for k in {(r["doc_id"], r["page"], r["line_ix"]) for r in x}}
    out, of_b = [], lines(b)
    for at, line in lines(a).items():
        other = of_b.get(at, [])
        for k, x in enumerate(line):
            for l, y in enumerate(other):
                if x["left"] > y["right"] or y["left"] > x["right"] or x["text"] == y["text"]:
                    continue
                off = abs(x["left"] - y["left"])
                if off + abs(x["right"] - y["right"]) < 0.1 * (x["right"] - x["left"]):
                    continue
                if x["right"] < y["right"]:
                    run = line[k : k + 2]
                    if len(run) == 2 and off + abs(y["right"] - run[1]["right"]) < 0.1 * (run[1]["right"] - x["left"]):
                        out.append((at, x["word_ix"], y["word_ix"], 2, 1, run[0]["text"] + run[1]["text"], y["text"]))
                    continue
                for n in (4, 3, 2):
                    run = other[l : l + n]
                    if len(run) == n and off + abs(x["right"] - run[-1]["right"]) < 0.1 * (run[-1]["right"] - x["left"]):
                        out.append((at, x["word_ix"], y["word_ix"], 1, n, x["text"], "".join(r["text"] for r in run)))
                        break
    return sorted(out)


def ours(a, b):
    return sorted(((r["doc_id"], r["page"], r["a_line"]), r["a_word"], r["b_word"], r["n_a"], r["n_b"], r["a_text"], r["b_text"]) for r in compare.k_to_one(a, b).collect())


def test_split_words_meet_the_one_they_come_from(spark):
    a = [row(0, "abcd", 0, 100), row(1, "xyz", 200, 300), row(2, "no", 400, 500), row(3, "we", 600, 650), row(4, "ll", 660, 700), row(0, "long", 0, 200, 1), row(0, "one", 0, 100, 2)]
    b = [row(0, "a", 0, 20), row(1, "b", 25, 45), row(2, "c", 50, 70), row(3, "d", 75, 100), row(4, "x", 200, 230), row(5, "y", 235, 260), row(6, "z", 265, 300), row(7, "n", 400, 440), row(8, "o", 450, 500), row(9, "well", 600, 700)]
    b += [row(0, "lo", 0, 90, 1), row(1, "n", 95, 190, 1), row(2, "g", 192, 200, 1), row(0, "0ne", 0, 101, 2)]
    got = ours(*(spark.createDataFrame(x, SHAPE) for x in (a, b)))
    of = lambda line: (1, 0, line)
    assert got == [(of(0), 0, 0, 1, 4, "abcd", "abcd"), (of(0), 1, 4, 1, 3, "xyz", "xyz"), (of(0), 2, 7, 1, 2, "no", "no"), (of(0), 3, 9, 2, 1, "well", "well"), (of(1), 0, 0, 1, 3, "long", "long")]


@pytest.mark.parametrize("layer", [layout.words_d, layout.words_e])
def test_equals_brute_force(spark, layer):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 12").select("doc_id", "text")
    for a, b in ((layout.words(docs), layer(docs)), (layer(docs), layout.words(docs))):
        want = brute(a.collect(), b.collect())
        assert ours(a, b) == want and want
    if layer is layout.words_e:
        assert {x[4] for x in brute(layout.words(docs).collect(), layer(docs).collect())} == {1, 2, 3, 4}
