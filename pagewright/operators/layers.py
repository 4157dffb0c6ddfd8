"""Choosing between a page's native text and its recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import without_ligatures

PAGE = ["doc_id", "page"]


def adds_new_text(native: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, keep) for pages with recognised words: whether these say enough that the native text does not.

    A word is new if it has two characters at least, a confidence of 85 or more, and is no part of the page's
    native stream of letters and digits. Two lines with three new words each, ten new numbers, or a hundred
    characters of new words keep the page; a page without native text is kept.
    """
    plain = F.regexp_replace(F.lower(without_ligatures(F.col("text"))), "[^a-z0-9]", "")
    stream = native.select(*PAGE, "line_ix", "word_ix", plain.alias("p")).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "word_ix", "p"))), lambda x: x["p"]), "").alias("stream"))
    w = found.withColumn("p", plain).join(stream, PAGE, "left")
    new = (F.length("p") >= 2) & (F.col("conf") >= 85) & ~F.col("stream").contains(F.col("p"))
    word = new & F.col("p").rlike("^[a-z]{3,}$") & F.col("p").rlike("[aeiouy]")
    line = w.groupBy(*PAGE, "line_ix").agg(F.bool_or(F.col("stream").isNull()).alias("bare"), F.count_if(word).alias("words"), F.sum(F.when(word, F.length("p")).otherwise(0)).alias("chars"), F.count_if(new & F.col("p").rlike("^[0-9]{2,}$")).alias("numbers"))
    return line.groupBy(*PAGE).agg((F.bool_or("bare") | (F.count_if(F.col("words") >= 3) >= 2) | (F.sum("numbers") >= 10) | (F.sum("chars") >= 100)).alias("keep"))


def combined(native: DataFrame, found: DataFrame, mask: DataFrame, gate: DataFrame) -> DataFrame:
    """(doc_id, page, layer): for each page of either, the recognised text where it was asked for and adds something, else the native."""
    pages = native.select(*PAGE, F.lit(True).alias("has_native")).distinct().join(found.select(*PAGE, F.lit(True).alias("has_found")).distinct(), PAGE, "full")
    use = F.coalesce("recognise", F.lit(False)) & F.coalesce("keep", F.lit(False)) & F.col("has_found").isNotNull()
    return pages.join(mask, PAGE, "left").join(gate, PAGE, "left").select(*PAGE, F.when(use, "found").when(F.col("has_native").isNotNull(), "native").otherwise("blank").alias("layer"))


_FAR = 1_000_000.0


def _beside(line: Column, lines: Column, width: float) -> Column:
    """The place among a page's lines of the one that a new line belongs to, -1 without one.

    Half of the line's height must fall within it. Of those the one that shares most of its width counts, or else the
    nearest to its side, unless that is further off than a twentieth of the page's width and than twice the way to the
    nearest line above or below that was seen before any fitted.
    """

    def step(m: Column, x: Column) -> Column:
        part = lambda s, e: F.greatest(F.lit(0.0), (F.least(line[e], x[e]) - F.greatest(line[s], x[s])) / (line[e] - line[s]))
        away = lambda s, e: F.least(F.abs(x[e] - line[s]), F.abs(x[s] - line[e])).cast("double")
        wide, high = part("left", "right"), part("top", "bottom")
        new = lambda **k: F.struct(*((k[c] if c in k else m[c]).alias(c) for c in ("at", "shared", "aside", "above")))
        up = F.when(high > 0, 0.0).otherwise(away("top", "bottom"))
        return (
            F.when((high >= 0.5) & (wide > m["shared"]), new(at=x["ix"], shared=wide))
            .when((high >= 0.5) & (wide == 0) & (m["shared"] == 0) & (away("left", "right") < m["aside"]), new(at=x["ix"], aside=away("left", "right")))
            .when((high < 0.5) & (m["at"] < 0) & (up < m["above"]), new(above=up)).otherwise(m)
        )

    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("shared"), F.lit(_FAR).alias("aside"), F.lit(_FAR).alias("above"))
    return F.aggregate(lines, start, step, lambda m: F.when((m["shared"] == 0) & (m["aside"] > 2 * m["above"]) & (m["aside"] > width * 0.05), -1).otherwise(m["at"]))


def placed_lines(base: DataFrame, new: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, line_ix, place, added): where new lines go among the base's, by their boxes, one after the other.

    place counts the page's lines of the base in their order; a line without one beside it is added after all others.
    A line that took another in is as large as both from then on. Lines without area belong nowhere.
    """
    box = ("left", "top", "right", "bottom")
    listed = lambda x, c: x.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_ix", *(F.col(b).cast("double").alias(b) for b in box)))).alias(c))
    both = listed(new.where("right > left and bottom > top"), "news").join(listed(base, "lines"), PAGE, "left")
    lines = F.coalesce(F.transform("lines", lambda x, i: F.struct(i.alias("ix"), *(x[b].alias(b) for b in box))), F.expr("cast(array() as array<struct<ix: int, left: double, top: double, right: double, bottom: double>>)"))

    def step(acc: Column, x: Column) -> Column:
        def put(at: Column) -> Column:
            joined = F.struct(at.alias("ix"), *((F.least if b in ("left", "top") else F.greatest)(x[b], F.get(acc["lines"], at)[b]).alias(b) for b in box))
            own = F.struct(F.size(acc["lines"]).alias("ix"), *(x[b].alias(b) for b in box))
            after = F.when(at < 0, F.concat(acc["lines"], F.array(own))).otherwise(F.transform(acc["lines"], lambda y: F.when(y["ix"] == at, joined).otherwise(y)))
            place = F.when(at < 0, F.size(acc["lines"])).otherwise(at).cast("long")
            return F.struct(after.alias("lines"), F.concat(acc["out"], F.array(F.struct(x["line_ix"].alias("line_ix"), place.alias("place"), (at < 0).alias("added")))).alias("out"))

        return F.transform(F.array(_beside(x, acc["lines"], width)), put)[0]

    start = F.struct(lines.alias("lines"), F.expr("cast(array() as array<struct<line_ix: bigint, place: bigint, added: boolean>>)").alias("out"))
    return both.select(*PAGE, F.explode(F.aggregate("news", start, step, lambda acc: acc["out"])).alias("o")).select(*PAGE, "o.*")


def joined_words(base: DataFrame, new: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, word_ix, text, box): the base's words and the new ones, in the lines that placed_lines found for them, from left to right."""
    own = base.withColumn("place", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line_ix")).cast("long") - 1)
    came = new.join(placed.select(*PAGE, "line_ix", "place"), [*PAGE, "line_ix"])
    cols = [*PAGE, "place", "text", "left", "top", "right", "bottom"]
    both = own.select(*cols, "word_ix", F.lit(0).alias("late")).unionByName(came.select(*cols, "word_ix", F.lit(1).alias("late")))
    at = F.row_number().over(Window.partitionBy(*PAGE, "place").orderBy("left", "late", "word_ix")).cast("long") - 1
    return both.select(*PAGE, F.col("place").alias("line_ix"), at.alias("word_ix"), "text", "left", "top", "right", "bottom")
