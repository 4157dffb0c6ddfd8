"""Edits of words, pages, links and outlines, and what people mark on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import meet
from ..functions.text import PLAIN, SUPERSCRIPTS, trimmed_edges

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "line_ix"]
WORD = [*LINE, "word_ix"]
BOX = ("left", "top", "right", "bottom")


def line_boxes(words: DataFrame) -> DataFrame:
    """(line's key, n_words, line, box): lines as their words make them; lines without words are gone."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*LINE).agg(F.count("*").alias("n_words"), text.alias("line"), *(f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))))


def without_words(words: DataFrame, keys: DataFrame) -> DataFrame:
    """The words but those with the keys given."""
    return words.join(keys.select(*WORD).distinct(), WORD, "left_anti")


def edited_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines after edits (line's key, text): a null text deletes the line, another one takes its place. Of several edits of a line the last by text counts."""
    last = edits.groupBy(*LINE).agg(F.max(F.struct(F.col("text").isNotNull().alias("stays"), "text")).alias("edit"))
    return lines.join(last, LINE, "left").where(F.col("edit").isNull() | F.col("edit.stays")).withColumn("line", F.coalesce("edit.text", "line")).drop("edit")


def touched_text(words: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): the words that share area with a box of (doc_id, page, ..., box), lines apart, for each group of boxes."""
    area = (F.least("a.right", "b.right") > F.greatest("a.left", "b.left")) & (F.least("a.bottom", "b.bottom") > F.greatest("a.top", "b.top"))
    hit = meet(words, boxes, PAGE).where(area).select(*(F.col(f"b.{c}").alias(c) for c in by), F.col("a.line_ix").alias("line_ix"), F.col("a.word_ix").alias("word_ix"), F.col("a.text").alias("text")).distinct()
    return joined_text(hit, by)


def joined_text(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): words in order, blanks between those of a line and line ends between lines."""
    lines = words.groupBy(*by, "line_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"]), " ").alias("line"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]), "\n").alias("text"))


def marked_words(words: DataFrame, marks: DataFrame) -> DataFrame:
    """(word's key, group, text): the words that a mark of (doc_id, page, group, box) contains whole."""
    inside = (F.col("b.left") <= F.col("a.left")) & (F.col("b.right") >= F.col("a.right")) & (F.col("b.top") <= F.col("a.top")) & (F.col("b.bottom") >= F.col("a.bottom"))
    return meet(words, marks, PAGE).where(inside).select(*(F.col(f"a.{c}").alias(c) for c in WORD), F.col("b.group").alias("group"), F.col("a.text").alias("text")).distinct()


def runs_of(words: DataFrame, phrase: str, loose: bool = False) -> DataFrame:
    """(first word's key, end_line, end_word, word boxes as parts): runs of a page's words that are a phrase's, one by one.

    With loose, words are compared in lower case without the marks at their edges, words of marks alone are passed
    over, and the last need only begin like the phrase's last.
    """
    told = words.withColumn("said", trimmed_edges(F.col("text")) if loose else F.col("text"))
    told = told.where("said <> ''")
    tokens = phrase.split()
    w = Window.partitionBy(*PAGE).orderBy("line_ix", "word_ix")
    part = F.struct("line_ix", "word_ix", *BOX)
    ahead = told.withColumns({f"said{k}": F.lead("said", k).over(w) if k else F.col("said") for k in range(len(tokens))} | {f"part{k}": F.lead(part, k).over(w) if k else part for k in range(len(tokens))})
    hit = F.lit(True)
    for k, t in enumerate(tokens):
        hit = hit & (F.col(f"said{k}").startswith(t) if loose and k == len(tokens) - 1 else F.col(f"said{k}") == t)
    last = f"part{len(tokens) - 1}"
    return ahead.where(hit).select(*WORD, F.col(f"{last}.line_ix").alias("end_line"), F.col(f"{last}.word_ix").alias("end_word"), F.array(*(f"part{k}" for k in range(len(tokens)))).alias("parts"))


def apart(runs: DataFrame, size: int) -> DataFrame:
    """Those of a page's runs of so many words that a reading from the first on takes, none overlapping the one before; places are word_ix within lines of twelve."""
    place = lambda r: r["line_ix"] * 1_000_000 + r["word_ix"]
    each = runs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_ix", "word_ix", "end_line", "end_word", "parts"))).alias("all"))
    step = lambda acc, r: F.when(place(r) > acc["end"], F.struct((r["end_line"] * 1_000_000 + r["end_word"]).alias("end"), F.concat(acc["out"], F.array(r)).alias("out"))).otherwise(acc)
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.slice("all", 1, 0).alias("out"))
    return each.select(*PAGE, F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("r")).select(*PAGE, "r.*")


def redaction_groups(runs: DataFrame) -> DataFrame:
    """(doc_id, page, group, line_ix, box): each run is a group of its own, with one box for what it has on a line; groups are numbered through the page."""
    numbered = runs.withColumn("group", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_ix", "word_ix")) - 1).cast("long"))
    each = numbered.select(*PAGE, "group", F.explode("parts").alias("p")).select(*PAGE, "group", "p.*")
    return each.groupBy(*PAGE, "group", "line_ix").agg(*(f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))))


def resolved_quotes(runs: DataFrame) -> DataFrame:
    """(doc_id, page, found, start_line): how often a quote stands on a page, and the line it begins on where it is the only one."""
    found = runs.groupBy(*PAGE).agg(F.count("*").alias("found"), F.min("line_ix").alias("line"))
    return found.select(*PAGE, "found", F.when(F.col("found") == 1, F.col("line")).alias("start_line"))


def cursors(runs: DataFrame) -> DataFrame:
    """Runs with their place in the document, and those of the one after and before, around the ends."""
    doc = Window.partitionBy("doc_id")
    at = F.row_number().over(doc.orderBy("page", "line_ix", "word_ix")) - 1
    n = runs.withColumns({"at": at.cast("long"), "n": F.count("*").over(doc)})
    return n.select(*WORD, "at", F.pmod(F.col("at") + 1, "n").alias("next"), F.pmod(F.col("at") - 1 + F.col("n"), "n").alias("previous"))


def superscripts_apart(words: DataFrame) -> DataFrame:
    """Words cut where superscript characters begin or end, each piece with its share of the box: (word's key, piece, text, sup, left, right)."""
    pieces = F.regexp_extract_all("text", F.lit(f"[{SUPERSCRIPTS}]+|[^{SUPERSCRIPTS}]+"), F.lit(0))
    cut = words.select(*WORD, "text", "left", "right", F.posexplode(pieces).alias("piece", "part"), pieces.alias("all"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("piece")), F.lit(0), lambda acc, x: acc + F.length(x))
    width = (F.col("right") - F.col("left")) / F.length("text")
    return cut.select(
        *WORD, F.col("piece").cast("long").alias("piece"), F.translate("part", SUPERSCRIPTS, PLAIN).alias("text"), F.col("part").rlike(f"^[{SUPERSCRIPTS}]").alias("sup"),
        F.floor(F.col("left") + width * before + 0.5).alias("left"), F.floor(F.col("left") + width * (before + F.length("part")) + 0.5).alias("right"),
    )


# Pages and outlines.


def duplication(pages: DataFrame, chosen: Column) -> DataFrame:
    """(doc_id, old, new): every page, and after each chosen one its copy."""
    before = F.coalesce(F.sum(F.when(chosen, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = pages.withColumns({"at": F.col("page") + before, "twice": chosen})
    return at.select("doc_id", F.col("page").alias("old"), F.explode(F.when(F.col("twice"), F.array("at", F.col("at") + 1)).otherwise(F.array("at"))).alias("new"))


def picked(pages: DataFrame, order: list[int]) -> DataFrame:
    """(doc_id, old, new): pages in the order given, which may repeat some; pages that a document lacks are passed over."""
    want = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("page")) for i, p in enumerate(order)))).alias("w")
    docs = pages.select("doc_id").distinct().select("doc_id", want).select("doc_id", "w.*")
    found = docs.join(pages.select("doc_id", "page"), PAGE)
    return found.select("doc_id", F.col("page").alias("old"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).cast("long").alias("new"))


def merged(page_counts: DataFrame, into: Column) -> DataFrame:
    """(into, doc_id, offset): where each document's pages begin in the file that its group is merged into, in the order of doc_id."""
    w = Window.partitionBy("into").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return page_counts.withColumn("into", into).select("into", "doc_id", F.coalesce(F.sum("page_count").over(w), F.lit(0)).alias("offset"))


def joined_outlines(outline: DataFrame, offsets: DataFrame) -> DataFrame:
    """(into, doc_id, node, level, title, page): outlines of merged documents, each below a node of its own, with pages counted through the file."""
    own = outline.join(offsets, "doc_id").select("into", "doc_id", "node", (F.col("level") + 1).alias("level"), "title", (F.col("page") + F.col("offset")).alias("page"))
    wrapper = offsets.select("into", "doc_id", F.lit(-1).cast("long").alias("node"), F.lit(1).cast("long").alias("level"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("offset").alias("page"))
    return own.unionByName(wrapper)


def remapped_links(links: DataFrame, page_map: DataFrame) -> DataFrame:
    """Links (doc_id, page, dest, ...) after pages moved; those on or to a page that is gone are gone."""
    at, to = page_map.select("doc_id", F.col("old").alias("page"), F.col("new").alias("_page")), page_map.select("doc_id", F.col("old").alias("dest"), F.col("new").alias("_dest"))
    kept = links.join(at, PAGE).join(to, ["doc_id", "dest"])
    return kept.select(*(F.col({"page": "_page", "dest": "_dest"}.get(c, c)).alias(c) for c in links.columns))


def curated(headings: DataFrame, keep: DataFrame) -> DataFrame:
    """Headings (doc_id, ix, level, title) that a list (doc_id, place, ix, level, title) keeps, in their own order: the first entry of each counts;
    a title of over 150 characters or none, and a level beyond 1 to 9, leave the heading's own."""
    first = keep.groupBy("doc_id", "ix").agg(F.min_by(F.struct(F.col("level").alias("new_level"), F.col("title").alias("new_title")), "place").alias("k"))
    level = F.when(F.col("k.new_level").between(1, 9), F.col("k.new_level")).otherwise(F.col("level"))
    title = F.when(F.length("k.new_title").between(1, 150), F.col("k.new_title")).otherwise(F.col("title"))
    return headings.join(first, ["doc_id", "ix"]).select("doc_id", "ix", level.alias("level"), title.alias("title"))
