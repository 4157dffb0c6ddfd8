import json

import pytest

from pagewright.plans import catalog
from pagewright.sources import formats


@pytest.mark.parametrize("name", ["azure_round_trip", "vision_round_trip"])
def test_no_word_is_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_no_page_is_copied_for_each_of_its_words(spark):
    files = spark.createDataFrame([(1, "{}")], "doc_id long, json string")
    for of, carried in ((formats.azure_words(files), "p#"), (formats.doc_ai_words(files), "text#")):
        plan = of._jdf.queryExecution().sparkPlan().toString()
        last = next(x for x in plan.split("\n") if "Generate" in x)
        assert carried not in last.rsplit("[", 2)[1], last[-300:]  # what goes with each word


def test_lines_of_a_paragraph(spark):
    word = lambda t, brk=None: {"symbols": [{"text": t} | ({"property": {"detectedBreak": {"type": brk}}} if brk else {})]}
    words = [word("a", "LINE_BREAK"), word("b"), word("c", "EOL_SURE_SPACE"), word("d", "LINE_BREAK")]
    pages = [{"blocks": [{"paragraphs": [{"words": words}, {"words": []}, {"words": words[1:2]}]}]}]
    got = formats.vision_words(spark.createDataFrame([(1, json.dumps({"responses": [{"fullTextAnnotation": {"pages": pages}}]}))], "doc_id long, json string"))
    assert sorted((r["par"], r["word_ix"], r["line"], r["text"]) for r in got.collect()) == [(0, 0, 0, "a"), (0, 1, 1, "b"), (0, 2, 1, "c"), (0, 3, 2, "d"), (2, 0, 0, "b")]
