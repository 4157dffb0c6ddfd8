import io
import json
import zipfile

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources import formats, layout, markup


def test_layout_wraps_and_numbers(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)) + "\n\nlast"), (2, ""), (3, None)], "doc_id long, text string")
    w = layout.words(df).orderBy("doc_id", "ls", "word_ix").collect()
    assert [r["ls"] for r in w] == [0] * 12 + [1] * 12 + [2] * 6 + [3] and w[-1]["par_id"] == 2
    assert (w[0]["left"], w[0]["right"], w[1]["left"]) == (20, 40, 50)
    assert all(r["top"] == 30 + 20 * r["line_ix"] for r in w)


def test_sniffer_takes_the_first_rule_that_holds(spark):
    rows = [
        ("x", "md", "md"), ('<alto xmlns="http://www.loc.gov/x">', "xml", "alto"), ('<?xml version="1.0"?><document xmlns="abbyy">', "xml", "abbyy"), ("<document name=''>", "xml", "stext"),
        ('{"DetectDocumentTextModelVersion": 1}', "json", "textract"), ('{"pages": 1, "fullTextAnnotation": 2}', "json", "google_vision"), ('{"pages": 1, "textAnchor": 2, "tokens": 3}', "json", "google_doc_ai"),
        ('{"createdDateTime": 1, "analyzeResult": 2, "modelId": 3}', "json", "azure_doc_intel"), ("<div class='ocr_page'>", "html", "hocr"), ("plain", "txt", "text"), ("plain", "bin", None),
    ]
    df = spark.createDataFrame(rows, "t string, e string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", formats.sniff(F.col("t"), F.col("e")).alias("got")).collect())


def test_pages_of_containers(spark):
    df = spark.createDataFrame([("<html><body><div class='ocr_page'>a</div><div class='ocr_page'>b</div>", "hocr"), ("<alto><Styles>s</Styles><Page A='1'>x</Page><Page A='2'>y</Page>", "alto"), ("<doc><page>1</page><page>2</page>", "stext"), ("t", "text")], "t string, k string")
    got = [r[0] for r in df.select(formats.split_pages(F.col("t"), F.col("k"))).collect()]
    assert [len(x) for x in got] == [2, 2, 2, 1] and got[1][1].startswith("<Styles>s</Styles><Page A='2'>")


def test_block_graphs(spark):
    box = lambda x: {"BoundingBox": {"Left": x, "Top": 0.5, "Width": 0.1, "Height": 0.1}}
    blocks = [{"Id": "l", "BlockType": "LINE", "Page": 1, "Geometry": box(0.1), "Relationships": [{"Type": "CHILD", "Ids": ["a", "b"]}]}, {"Id": "a", "BlockType": "WORD", "Text": "one", "Confidence": 99.0, "Geometry": box(0.1)}, {"Id": "b", "BlockType": "WORD", "Text": "two", "Confidence": 50.0, "Geometry": box(0.2)}]
    df = spark.createDataFrame([(1, json.dumps({"Blocks": blocks}))], "doc_id long, json string")
    got = formats.textract_words(df, 1000, 2000).orderBy("ix").collect()
    assert [(r["text"], r["page"], round(r["left"]), round(r["top"])) for r in got] == [("one", 0, 100, 1000), ("two", 0, 200, 1000)]


def test_symbols_make_words_and_lines(spark):
    word = lambda t, brk=None: {"confidence": 0.5, "boundingBox": {"vertices": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}, "symbols": [{"text": c} for c in t[:-1]] + [{"text": t[-1], "property": {"detectedBreak": {"type": brk}}}]}
    doc = {"responses": [{"context": {"pageNumber": 2}, "fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [word("ab", "SPACE"), word("cd", "LINE_BREAK"), word("ef")]}]}]}]}}]}
    got = formats.vision_words(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")).orderBy("word_ix").collect()
    assert [(r["page"], r["line"], r["text"], r["right"]) for r in got] == [(1, 0, "ab", 3), (1, 0, "cd", 3), (1, 1, "ef", 3)]


def test_spans_hold_words(spark):
    azure = {"analyzeResult": {"pages": [{"pageNumber": 1, "words": [{"content": "ab", "confidence": 0.987, "polygon": [1, 2, 3, 2, 3, 4, 1, 4], "span": {"offset": 3, "length": 2}}], "lines": [{"spans": [{"offset": 0, "length": 2}]}, {"spans": [{"offset": 3, "length": 9}]}]}]}}
    r = formats.azure_words(spark.createDataFrame([(1, json.dumps(azure))], "doc_id long, json string")).first()
    assert (r["line"], r["text"], r["conf"], r["right"]) == (1, "ab", 99, 3)
    seg = lambda a, b: {"layout": {"textAnchor": {"textSegments": [{"startIndex": str(a), "endIndex": str(b)}]}}}
    doc = {"text": "one two\nthree", "pages": [{"tokens": [seg(0, 4), seg(4, 8), seg(8, 13)], "lines": [seg(0, 8), seg(8, 13)]}]}
    got = formats.doc_ai_words(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")).orderBy("ix").collect()
    assert [(x["line"], x["text"]) for x in got] == [(0, "one"), (0, "two"), (1, "three")]


def test_markdown_and_word(spark):
    text = "---\na: b\n---\n# Title *one*\nbody **bold** and\n[link](http://x) text\n\nSecond\n---\n- item\n1. first\n> said\n```\ncode\n```\n[^1]: note"
    assert markup.markdown_blocks(text) == [("title", 1, None, "Title one"), ("body", None, None, "body bold and link text"), ("title", 2, None, "Second"), ("list", 1, "-", "item"), ("list", 1, "1.", "first"), ("quote", None, None, "said"), ("code", None, None, "code"), ("footnote", None, "1", "note")]
    data = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    got = markup.docx(spark.createDataFrame([(1, data.getvalue()), (2, b"no zip"), (3, None)], "doc_id long, content binary")).collect()
    assert [(r["doc_id"], r["type"], r["text"]) for r in got] == [(1, "title", "Head"), (1, "body", "a\tb")]


def test_boxed_characters_make_words(spark):
    ch = lambda c, x: f'<charParams l="{x}" t="1" r="{x + 5}" b="9">{c}</charParams>'
    xml = "<page><line baseline='9'>" + ch("a", 0) + ch("b", 6) + ch(" ", 12) + ch("c", 18) + "</line></page>"
    got = markup.char_words(spark.createDataFrame([(1, 0, xml)], "doc_id long, page long, xml string")).orderBy("word_ix").collect()
    assert [(r["text"], r["left"], r["right"]) for r in got] == [("ab", 0, 11), ("c", 18, 23)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(T.curly_quotes(lit("'tis"))) == "‘tis" and one(T.curly_quotes(lit('say"'))) == "say”" and one(T.curly_quotes(lit("don't"))) == "don’t"
    assert one(T.without_ligatures(lit("ﬁne oﬀ"))) == "fine off" and one(T.without_superscripts(lit("x²"))) == "x2"
    assert one(T.language(lit("abc Ж 漢"))) == "rus" and one(T.language(lit("abé"))) == "eng" and one(T.language(lit("漢Ж"))) == "chi_sim"
    assert one(T.upper_median(F.array(*map(lit, (4, 1, 3, 2))))) == 3 and one(T.middle_mean(F.array(*map(lit, (1.0, 5.0, 2.0))))) == 5.0
    assert [one(T.column_name(lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(T.font_class(lit("Times New Roman"))) == "SerifDefault" and one(T.font_class(lit("Arial"))) == "SansDefault" and one(T.font_class(lit(""))) == "Default"
    assert one(T.occurrences(lit("aaaa"), "aa")) == 2 and one(T.occurrences(lit("aaaa"), "aa", overlapping=True)) == 3
    assert one(T.unescape_xml(T.escape_xml(lit("a<b>&'\"")))) == "a<b>&'\""
    assert one(markup.ends_sentence(lit('end."'))) and not one(markup.ends_sentence(lit("Mr.")))
