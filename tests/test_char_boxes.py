import re

import pyarrow as pa
import pytest

from pagewright.plans import catalog
from pagewright.sources import charboxes, columns, markup

from .harness import differences

ODD = [
    '<line b="1"><charParams l="1" t="2" r="3" b="4">a</charParams><charParams l="-5" t="2.5" r="7" b="1.2.3">"</charParams><charParams l="9"> </charParams><charParams></charParams>'
    '<charParams suspicious="1" r="8" l="6" t="." b="99999999999999999999">é\U0001d11e</charParams></line>\n<line ></line><line x><charParams>  </charParams><charParams wl="3" l="x" l="4" r="">l="7"</charParams><charParams l=" 1234567" t="\t1234567" r="12345678" b="123456789">u</charParams></line>',
    '<line a <line b><charParams l="1"<charParams l="2">in</charParams><charParams l="3"<b>x</b></charParams><charParams t="1">open</line><charParams l="1" t="1" r="1" b="1">out</charParams>',
    None, "", '<li', 'ne ><charParams l="1">a</charParams></line>', '<line ><charParams l="1">lost</charParams>', '<line ><charParams suspicious="true" l="4" l="5">k</charParams></line> </line><lines></line>', "<line ><charParams l=\"1",
    '">z</charParams></line>', '<line ><formatting lang="x"><charParams l="1" suspicious="0">p</charParams></formatting><charParamsX b="7">q</charParamsX><charParams b="8">s></charParams></line>',
]


def plainly(xml):
    """(line, word, text, box, doubtful) by patterns, a character at a time."""
    for line, x in enumerate(re.findall(r"(?s)<line .*?</line>", xml or "")):
        words, word = {}, 0
        for c in re.findall(r"<charParams[^>]*>[^<]*</charParams>", x):
            ch = re.search(r">([^<]*)<", c)[1]
            if not ch.strip(" "):
                word += 1
                continue
            sides = [m[1] if (m := re.search(rf'\b{k}="(-?[0-9.]+)"', c)) else "" for k in "ltrb"]
            sides = [float(v) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", v) else None for v in sides]
            words.setdefault(word, []).append((ch, sides, 'suspicious="1"' in c or 'suspicious="true"' in c))
        for k, cs in words.items():
            side = lambda i, f: f((s[i] for _, s, _ in cs if s[i] is not None), default=None)  # noqa: B023, E731
            yield line, k, "".join(c for c, _, _ in cs), side(0, min), side(1, min), side(2, max), side(3, max), any(d for _, _, d in cs)


@pytest.mark.parametrize("most", [charboxes.BYTES, 1])
def test_odd_markup_is_read_as_by_patterns(spark, most, monkeypatch):
    monkeypatch.setattr(charboxes, "BYTES", most)
    got = [(int(w["row"][i]), int(w["line_ix"][i]), int(w["word_ix"][i]), w["text"][i].as_py(), *(None if w[c][i] != w[c][i] else float(w[c][i]) for c in ("left", "top", "right", "bottom")), bool(w["doubtful"][i])) for w in charboxes.read(pa.array(ODD, pa.string())) for i in range(len(w["row"]))]
    assert got == [(row, *w) for row, x in enumerate(ODD) for w in plainly(x)]
    table = markup.char_words(spark.createDataFrame(list(enumerate(ODD)), "page int, xml string").selectExpr("cast(page as string) as doc_id", "page", "xml"))
    assert sorted(tuple(r)[1:] for r in table.collect()) == sorted(got, key=lambda r: r[:3])


@pytest.mark.parametrize("most", [charboxes.CHARS, 1])
def test_written_pages_say_each_character(most, monkeypatch):
    monkeypatch.setattr(charboxes, "CHARS", most)
    texts = ["a<b é\U0001d11e\n\"c\" l=\"5\"\n" + "\n".join("w%d x" % i for i in range(60)), None, "", "z&"]
    a = columns.words(pa.array([3, 4, 5, 6], pa.int64()), pa.array(texts))
    pages = [(int(r), int(p), x.as_py()) for row, page, xml in charboxes.written(a) for r, p, x in zip(row, page, xml)]
    assert [x[:2] for x in pages] == [(0, 0), (0, 1), (3, 0)]
    char = lambda c, x, t: f'<charParams l="{x}" t="{t}" r="{x + 10}" b="{t + 16}">{c}</charParams>'
    blank, line = '<charParams l="0" t="0" r="0" b="0"> </charParams>', '<line baseline="1" l="1">'
    assert pages[2][2] == line + char("z", 20, 30) + char("x", 30, 30) + "</line>"
    assert pages[0][2].startswith(line + char("a", 20, 30) + char("x", 30, 30) + char("b", 40, 30) + blank + char("é", 60, 30) + char("\U0001d11e", 70, 30) + "</line>\n" + line + char('"', 20, 50))
    assert [len(re.findall("<line ", x[2])) for x in pages] == [50, 12, 1]


def test_round_trip(spark, tmp_path):
    odd = [(-7, "one  two\tthree\n\n  four\n"), (3, ""), (4, None), (5, "\n \n"), (6, "\U0001d11e éx t ﬁne <&> a.\r x"), (11, "extraordinarily " * 700), (12, 'l="9" "' * 300)]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert not differences(spark, catalog.QUERIES, catalog.SQL, "char_xml_round_trip", str(tmp_path), con)
    plan = catalog.QUERIES["char_xml_round_trip"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # characters are no rows
