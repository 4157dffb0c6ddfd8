"""Words as text, Markdown, CSV, hOCR, ALTO and session records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_markdown, escape_xml

LINE = ["doc_id", "page", "line_ix"]


def _joined(parts: Column, sep: str, field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x[field]), sep)


def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, par_id, line, box) of words."""
    return words.groupBy(*LINE).agg(
        F.min("par_id").alias("par_id"), _joined(F.collect_list(F.struct("word_ix", "text")), " ", "text").alias("line"), F.count("*").alias("n_words"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
    )


def _pages(each: DataFrame, sep: str = "") -> DataFrame:
    return each.groupBy("doc_id").agg(_joined(F.collect_list(F.struct("page", "line_ix", "part")), sep, "part").alias("text"))


def plain_text(words: DataFrame) -> DataFrame:
    """Each line on a line of its own, the first one too."""
    return _pages(lines(words).select(*LINE, F.concat(F.lit("\n"), "line").alias("part")))


def reflowed(words: DataFrame) -> DataFrame:
    """Paragraphs on lines of their own; pages after the first begin one."""
    ln = lines(words)
    w = Window.partitionBy("doc_id").orderBy("page", "line_ix")
    first, new_page = F.lag("par_id").over(w).isNull(), F.lag("page").over(w) != F.col("page")
    sep = F.when(first, "").when(new_page | (F.lag("par_id").over(w) != F.col("par_id")), "\n").otherwise(" ")
    return _pages(ln.withColumn("part", F.concat(sep, "line")))


def numbered(words: DataFrame) -> DataFrame:
    return _pages(lines(words).select(*LINE, F.concat("page", F.lit(":"), "line_ix", F.lit("  "), "line").alias("part")), "\n")


def spaced(words: DataFrame, width: int = 1500, columns: int = 120) -> DataFrame:
    """Lines whose words stand at the columns of a grid of characters: (doc_id, page, line_ix, line)."""
    parts = F.array_sort(F.collect_list(F.struct("word_ix", F.floor(F.col("left") / F.lit(width) * columns + 0.5).cast("int").alias("at"), "text")))
    put = lambda acc, x: F.concat(acc, F.repeat(F.lit(" "), F.greatest(F.when(acc == "", 0).otherwise(1), x["at"] - F.length(acc)).cast("int")), x["text"])
    return words.groupBy(*LINE).agg(F.aggregate(parts, F.lit(""), put).alias("line"))


def markdown(words: DataFrame) -> DataFrame:
    """Lines of escaped words, runs of one style between marks, with a rule between pages: (doc_id, text). A word is bold where its style says so."""
    w = Window.partitionBy(*LINE).orderBy("word_ix")
    run = words.withColumn("_new", F.when(F.coalesce(F.lag("bold").over(w) == F.col("bold"), F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = run.groupBy(*LINE, "_run", "bold").agg(_joined(F.collect_list(F.struct("word_ix", escape_markdown(F.col("text")).alias("t"))), " ", "t").alias("t"))
    marked = runs.withColumn("t", F.when(F.col("bold"), F.concat(F.lit("**"), "t", F.lit("**"))).otherwise(F.col("t")))
    ln = marked.groupBy(*LINE).agg(_joined(F.collect_list(F.struct("_run", "t")), " ", "t").alias("line"))
    page = ln.groupBy("doc_id", "page").agg(_joined(F.collect_list(F.struct("line_ix", "line")), "\n", "line").alias("t"))
    return page.groupBy("doc_id").agg(_joined(F.collect_list(F.struct("page", "t")), "\n\n---\n\n", "t").alias("text"))


def csv_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, word_ix, row): numbers bare, text quoted with doubled quotes."""
    text = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    return words.select(*LINE, "word_ix", F.concat_ws(",", "page", "line_ix", "word_ix", text, "left", "top", "right", "bottom", "conf").alias("row"))


def _box(a: str = "") -> Column:
    return F.concat_ws(" ", *(F.col(a + c).cast("string") for c in ("left", "top", "right", "bottom")))


def hocr(words: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, page, xml) in hOCR."""
    word = F.concat(F.lit("<span class='ocrx_word' id='word_"), F.concat_ws("_", "page", "line_ix", "word_ix"), F.lit("' title='bbox "), _box(), F.lit(";x_wconf "), F.col("conf"), F.lit("'>"), escape_xml(F.col("text")), F.lit("</span>"))
    ln = words.withColumn("w", word).groupBy(*LINE).agg(_joined(F.collect_list(F.struct("word_ix", "w")), " ", "w").alias("w"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    ln = ln.withColumn("l", F.concat(F.lit("<span class='ocr_line' title=\"bbox "), _box(), F.lit('; baseline 0 0">'), "w", F.lit("</span>")))
    page = ln.groupBy("doc_id", "page").agg(_joined(F.collect_list(F.struct("line_ix", "l")), "\n", "l").alias("l"))
    return page.select("doc_id", "page", F.concat(F.lit(f"<div class='ocr_page' title='bbox 0 0 {width} {height}'>\n"), "l", F.lit("\n</div>")).alias("xml"))


def alto(words: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, page, xml) in ALTO."""
    size = lambda: (F.lit(' HPOS="'), F.col("left"), F.lit('" VPOS="'), F.col("top"), F.lit('" WIDTH="'), F.col("right") - F.col("left"), F.lit('" HEIGHT="'), F.col("bottom") - F.col("top"), F.lit('"'))
    word = F.concat(F.lit('<String CONTENT="'), escape_xml(F.col("text")), F.lit('"'), *size(), F.lit(' WC="'), F.format_string("%.2f", F.col("conf") / 100.0), F.lit('"/>'))
    ln = words.withColumn("w", word).groupBy(*LINE, "par_id").agg(_joined(F.collect_list(F.struct("word_ix", "w")), "<SP/>", "w").alias("w"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    ln = ln.withColumn("l", F.concat(F.lit("<TextLine"), *size(), F.lit(">"), "w", F.lit("</TextLine>")))
    par = ln.groupBy("doc_id", "page", "par_id").agg(F.min("line_ix").alias("at"), F.concat(F.lit("<TextBlock>"), _joined(F.collect_list(F.struct("line_ix", "l")), "", "l"), F.lit("</TextBlock>")).alias("b"))
    page = par.groupBy("doc_id", "page").agg(_joined(F.collect_list(F.struct("at", "b")), "\n", "b").alias("b"))
    return page.select("doc_id", "page", F.concat(F.lit(f'<Page WIDTH="{width}" HEIGHT="{height}"><PrintSpace>'), "b", F.lit("</PrintSpace></Page>")).alias("xml"))


def session(words: DataFrame) -> DataFrame:
    """(doc_id, page, record): a page as a JSON record of lines of words."""
    word = F.struct("word_ix", "text", "conf", F.struct("left", "top", "right", "bottom").alias("bbox"))
    ln = words.groupBy(*LINE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    page = ln.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_ix", "words"))).alias("lines"))
    return page.select("doc_id", "page", F.to_json(F.struct(F.col("page").alias("i"), F.struct("lines").alias("ocr"))).alias("record"))
