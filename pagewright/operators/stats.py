"""Medians over counted values, and spacing of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_upper_median(counts: DataFrame, by: list[str], value: str, n: str, name: str, total: str) -> DataFrame:
    """(by, name, total) from (by, value, n): the upper median of values that occur n times, from distinct values only."""
    w = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum(n).over(w.orderBy(value))).withColumn("_all", F.sum(n).over(w))
    return upto.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(name), F.first("_all").alias(total))


def kernings(words: DataFrame) -> DataFrame:
    """(pair, gap): gaps above zero between the cells of neighbouring characters of a word, worked out within the word's row."""
    ch = F.split("text", "")
    jitter = lambda i: (i * 3 + F.col("word_ix")) % 3
    pairs = F.transform(F.slice(ch, F.lit(1), F.size(ch) - 1), lambda c, i: F.struct(F.concat(c, F.lit(","), F.get(ch, i + 1)).alias("pair"), jitter(i + 1).alias("gap")))
    return words.where(F.length("text") > 1).select(F.explode(pairs).alias("x")).select("x.*").where("gap > 0")
