"""Cases that fix what the text functions tell."""

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources import markup


def many(spark, texts, f, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_enumerators(spark):
    lines = ["Sec. 12. Scope", "Section IV text", "Article x", "§ none", "FN12. note", "(3) a", "(iv) b", "(i) c", "(ab) d", "[7] e", "12. f", "12) g", "ii) h", "xiv. i", "b) j", "B. k", "• l", "- m", "→ n", "+ o", "1.2 p", "plain", "", None, "(1234) q"]
    want = [
        ("section", 12), ("section", 4), ("section", 10), None, ("sup-ref", 12), ("paren-num", 3), ("paren-roman", 4), ("paren-alpha", 9), ("paren-alpha", None), ("bracket-num", 7), ("num-dot", 12), ("num-dot", 12), ("roman-paren", 2), ("roman-dot", 14),
        ("alpha-paren", 2), ("alpha-dot", 2), ("bullet", None), ("bullet", None), ("bullet", None), None, None, None, None, None, None,
    ]
    assert [r and tuple(r) for r in many(spark, lines, T.enumerated)] == want


def test_sentence_ends(spark):
    words = ["end.", "end!", 'end."', "end.)", "Mr.", "e.g.", "U.S.", "A.", "12.", "wait..", "etc.", "why?", "no", "", ".", "(p.", "St.", "3.5"]
    assert many(spark, words, markup.ends_sentence) == [True, True, True, True, False, False, False, False, False, False, False, True, False, False, True, True, True, False]


def test_fonts_ligatures_and_numerals(spark):
    assert many(spark, ["Century Gothic", "Gothic", "My_Sans", "Open Serif", "Roman", "SansRom", None, "Default", "Symbol MT", "x"], T.font_class) == ["SerifDefault", "SansDefault", "SansDefault", "SerifDefault", "SerifDefault", "SansDefault", "Default", "Default", "SymbolDefault", "Default"]
    assert many(spark, ["ﬁ", "fi", "ſt", "st", "IJ", "q", None], T.ligature_of) == ["ﬁ", "ﬁ", "ﬅ", "ﬆ", "Ĳ", None, None]
    assert many(spark, ["IV", "mcmxcix", "iiii", "abc", "", None], T.roman) == [4, 1999, 4, None, None, None]
    nums = [1, 4, 9, 14, 40, 90, 400, 1994, 3999]
    back = spark.createDataFrame([(n,) for n in nums], "n int").select("n", T.roman(T.to_roman(F.col("n"))).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in back)


def test_entities(spark):
    assert many(spark, ["&lt;a&gt;", "&amp;lt;", "&#x41;&#x20ac;z", "soft­hyphen", "&#39;&quot;", None, "&#xzz;"], T.unescape_xml) == ["<a>", "<", "A€z", "soft-hyphen", "'\"", None, "&#xzz;"]


def test_names_options_and_ranges(spark):
    assert many(spark, ["a/b/Doc.PDF", "Doc.pdf.pdf", "x", "a/", None], T.title_of) == ["Doc", "Doc.pdf", "x", "", None]
    assert many(spark, ["ok", "", "a\\b", ".x", "a:b", "a ", "a."], T.folder_problem) == [None, "empty", "slash", "dot", "mark", "end", "end"]
    got = many(spark, ["k=1", " k = true,x", "k", "=1", "k=", None], T.option)
    assert [r and (r["key"], r["kinds"], r["values"]) for r in got] == [("k", ["number"], ["1"]), ("k", ["boolean", "text"], ["true", "x"]), None, None, ("k", ["text"], [""]), None]
    assert many(spark, ["0-4,7", "3", "5-3", "2,2,1-2", "x", "1-"], T.page_range) == [[0, 1, 2, 3, 4, 7], [3], [], [1, 2], None, None]
