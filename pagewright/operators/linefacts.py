"""Facts about lines, sizes and characters that layout rules go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import middle_mean, upper_median

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "line_ix"]
# Dots and marks before numbers of lines, tokens of numbers, letters by their heights.
LEADERS, NUMBER = "·•∙⋅‧․", r"^[0-9,$%.()+-]+$"
ASCENDERS, X_HEIGHT = "ABCDEFGHIKLMNOPRSTUVWXYZbdhklt0123456789", "acemnorsuvwxz"


def neighbours(lines: DataFrame) -> DataFrame:
    """Lines with the texts before and after them on their page."""
    w = Window.partitionBy(*PAGE).orderBy("line_ix")
    return lines.select(*LINE, F.lag("line").over(w).alias("previous"), F.lead("line").over(w).alias("next"))


def line_number(line: Column) -> Column:
    """(value, standalone) of the number that a line begins with, after leader dots; null without one."""
    words = F.filter(F.split(line, " ", -1), lambda x: ~x.rlike(f"^[{LEADERS}]+$"))
    value = F.regexp_extract(F.get(words, 0), f"^[{LEADERS}]*([0-9]{{1,4}})[{LEADERS}]*$", 1).try_cast("int")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), (F.size(words) == 1).alias("standalone")))


def right_clustered(line: Column) -> Column:
    """Whether a line ends in three numbers at least, after its last word that is none."""
    words = F.split(line, " ", -1)
    told = lambda x: x.rlike(NUMBER) & (x.rlike("[0-9]") | (x == "-"))
    last = F.aggregate(F.transform(words, lambda x, i: F.when(~x.rlike(NUMBER), i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    return (F.size(words) >= 4) & (F.size(F.filter(F.slice(words, last + 2, F.size(words)), told)) >= 3)


def body_size(sizes: DataFrame) -> DataFrame:
    """(doc_id, body_size) of (doc_id, size, chars): the largest size that three tenths of the characters have, else the one that most have, the smaller of two."""
    by = sizes.groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"))
    whole = by.groupBy("doc_id").agg(F.sum("chars").alias("whole"), F.max_by("size", F.struct("chars", (-F.col("size")).alias("less"))).alias("mode"))
    large = by.join(whole, "doc_id").groupBy("doc_id").agg(F.max(F.when(F.col("chars") >= 0.3 * F.col("whole"), F.col("size"))).alias("large"), F.first("mode").alias("mode"))
    return large.select("doc_id", F.coalesce("large", "mode").alias("body_size"))


def clusters(values: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """(by, cluster, centre, n): values in order, cut where the next is more than a gap away."""
    each = values.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("v")
    cut = each.withColumn("new", F.when(F.col("v") - F.lag("v").over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(w))
    return cut.groupBy(*by, "cluster").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("centre"), F.sum("n").alias("n"))


def page_angle(lines: DataFrame) -> DataFrame:
    """(doc_id, page, angle) in degrees of (doc_id, page, width, slope): the middle half's mean slope of lines of 200 pixels and more; 0 without any."""
    wide = lines.groupBy(*PAGE).agg(F.collect_list(F.when(F.col("width") >= 200, F.col("slope"))).alias("s"))
    return wide.select(*PAGE, F.when(F.size("s") > 0, F.degrees(F.asin(middle_mean(F.col("s"))))).otherwise(0.0).alias("angle"))


def letter_heights(chars: DataFrame) -> DataFrame:
    """(line's key, ascender, x_height): the upper medians of the heights of letters of either kind, null without any."""
    tall = lambda kinds: F.collect_list(F.when(F.position(F.col("ch"), F.lit(kinds)) > 0, F.col("bottom") - F.col("top")))
    return chars.groupBy(*LINE).agg(tall(ASCENDERS).alias("a"), tall(X_HEIGHT).alias("x")).select(*LINE, upper_median(F.col("a")).alias("ascender"), upper_median(F.col("x")).alias("x_height"))


def monospaced(widths: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, monospaced) of (doc_id, ch, width, obs): whether i and l are more than seven tenths as wide as m and w, as far as they were seen often enough."""
    mean = lambda kinds: F.avg(F.when(F.col("ch").isin(*kinds) & (F.col("obs") >= least), F.col("width")))
    return widths.groupBy("doc_id").agg(mean("il").alias("narrow"), mean("mw").alias("wide")).select("doc_id", F.coalesce(F.col("narrow") / F.col("wide") > 0.7, F.lit(False)).alias("monospaced"))


def sampled_pages(pages: DataFrame, enough: int = 500) -> DataFrame:
    """Pages (doc_id, page, n_words) up to the one with which more than enough words are seen."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("seen", F.coalesce(F.sum("n_words").over(w), F.lit(0))).where(F.col("seen") <= enough)
