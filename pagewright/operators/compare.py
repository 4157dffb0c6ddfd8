"""Comparison of word layers by place: pairs, accuracy, flags, several words against one, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import meet, overlap, shrunk

PAGE = ["doc_id", "page"]
WORD = ["doc_id", "page", "line_ix", "word_ix"]
METRICS = ("total", "correct", "incorrect", "missed", "extra", "correct_low_conf", "incorrect_high_conf")
LOW, HIGH = 75, 85


def pairs(a: DataFrame, b: DataFrame, same: Column | None = None) -> DataFrame:
    """Words of a and b that meet on a page once both are shrunk by a tenth of their height, with same: whether their texts agree."""
    same = (F.col("a.text") == F.col("b.text")) if same is None else same
    return meet(shrunk(a, 0.1), shrunk(b, 0.1), PAGE).select(
        "a.doc_id", "a.page", F.col("a.line_ix").alias("a_line"), F.col("a.word_ix").alias("a_word"), F.col("b.line_ix").alias("b_line"), F.col("b.word_ix").alias("b_word"),
        F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"), F.col("a.conf").alias("a_conf"), F.col("a.left").alias("a_left"), F.col("a.right").alias("a_right"), F.col("b.left").alias("b_left"), F.col("b.right").alias("b_right"), same.alias("same"),
    )


def evaluate(a: DataFrame, b: DataFrame, by: list[str], same: Column | None = None) -> DataFrame:
    """The seven counts of layer a against the truth b, for each group of by (a prefix of the words' key).

    Pairs count for the word on either side, and the words of both layers stand beside them, so one sum by word and
    one by group tell everything.
    """
    word = lambda side, line, ix, here, met, ok, low, high: F.struct(
        F.lit(side).alias("side"), F.col(line).alias("line"), F.col(ix).alias("ix"), F.lit(here).alias("here"), F.lit(met).alias("met"), ok.alias("ok"), low.alias("low"), high.alias("high")
    )
    no = F.lit(False)
    found = pairs(a, b, same).select("doc_id", "page", F.explode(F.array(word("b", "b_line", "b_word", 0, 1, F.col("same"), F.col("a_conf") <= LOW, F.col("a_conf") > HIGH), word("a", "a_line", "a_word", 0, 1, no, no, no))).alias("w"))
    own = [x.select("doc_id", "page", word(t, "line_ix", "word_ix", 1, 0, no, no, no).alias("w")) for t, x in (("a", a), ("b", b))]
    each = found.unionByName(own[0]).unionByName(own[1]).select("doc_id", "page", "w.*").groupBy("doc_id", "page", "side", "line", "ix")
    flags = each.agg(F.sum("here").alias("here"), F.max("met").alias("met"), F.bool_or("ok").alias("ok"), F.bool_or("low").alias("low"), F.bool_or("high").alias("high"))
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    truth, met, ok = F.col("side") == "b", F.col("met") > 0, F.col("ok")
    total = lambda x: F.coalesce(F.sum(F.when(x, F.col("here")).otherwise(0)), F.lit(0)).cast("long")
    return flags.groupBy(*by).agg(
        total(truth).alias("total"), count(truth & met & ok).alias("correct"), count(truth & met & ~ok).alias("incorrect"), (total(truth) - count(truth & met)).alias("missed"), (total(~truth) - count(~truth & met)).alias("extra"),
        count(truth & met & ok & F.col("low")).alias("correct_low_conf"), count(truth & met & ~ok & F.col("high")).alias("incorrect_high_conf"),
    )


def summed(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.sum(c).alias(c) for c in METRICS))


def match_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each word of a: whether it was ever compared, and whether it ever agreed; its new confidence is 100 or 0."""
    flags = pairs(a, b).groupBy("doc_id", "page", F.col("a_line").alias("line_ix"), F.col("a_word").alias("word_ix")).agg(F.bool_or("same").alias("match"))
    return a.join(flags, WORD, "left").select(*WORD, F.col("match").isNotNull().alias("compared"), F.coalesce("match", F.lit(False)).alias("matched"), F.when(F.coalesce("match", F.lit(False)), 100).otherwise(0).alias("new_conf"))


def one_to_one(found: DataFrame) -> Column:
    """Whether two words' left and right edges differ by less than a tenth of the width of a's."""
    return F.abs(F.col("a_left") - F.col("b_left")) + F.abs(F.col("a_right") - F.col("b_right")) < 0.1 * (F.col("a_right") - F.col("a_left"))


def several_to_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of b that run over two words of a which touch: (word's key in a and b, the two texts joined, agreement)."""
    line = Window.partitionBy("doc_id", "page", "line_ix").orderBy("word_ix")
    two = a.withColumns({"text": F.concat("text", F.lead("text").over(line)), "right": F.lead("right").over(line)}).where("right is not null")
    fits = F.abs(F.col("a_left") - F.col("b_left")) + F.abs(F.col("a_right") - F.col("b_right")) < 0.1 * (F.col("a_right") - F.col("a_left"))
    return pairs(two, b).where(fits).select("doc_id", "page", "a_line", "a_word", "b_line", "b_word", "a_text", "b_text", "same")


def _runs(words: DataFrame, most: int) -> DataFrame:
    """words with run1, right1, ...: the text and right edge of the run of the word and the next one, two, ... of its line; null where the line ends."""
    line = Window.partitionBy("doc_id", "page", "line_ix").orderBy("word_ix")
    text = lambda k: F.concat(*(F.col("text") if i == 0 else F.lead("text", i).over(line) for i in range(k + 1)))
    return words.withColumns({f"run{k}": text(k) for k in range(1, most + 1)} | {f"right{k}": F.lead("right", k).over(line) for k in range(1, most + 1)})


def k_to_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of one layer's words against one word of the other: (first words' keys, n_a and n_b words, the texts run together, agreement).

    Only words that meet, differ in text and are not one to one count. Where a's word ends first, it and the next
    of a are tried against b's word; otherwise a's word against four, three and two words of b, the longest
    first. The edges may differ by less than a tenth of the run's width, as measured from a's left edge.
    """
    found = meet(shrunk(_runs(a, 1), 0.1), shrunk(_runs(b, 3), 0.1), PAGE).select(
        "a.doc_id", "a.page", *(F.col(f"{t}.{c}_ix").alias(f"{t}_{c}") for t in "ab" for c in ("line", "word")), *(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in ("text", "left", "right", "run1", "right1")),
        *(F.col(f"b.{c}{k}").alias(f"b_{c}{k}") for k in (2, 3) for c in ("run", "right")),
    )
    off = F.abs(F.col("a_left") - F.col("b_left"))
    fits = lambda run, one: F.coalesce(off + F.abs(F.col(run) - F.col(one)) < 0.1 * (F.col(run) - F.col("a_left")), F.lit(False))
    ends_first = F.col("a_right") < F.col("b_right")
    n_a = F.when(ends_first & fits("a_right1", "b_right"), 2).when(~ends_first, 1)
    n_b = F.when(ends_first, 1).when(fits("b_right3", "a_right"), 4).when(fits("b_right2", "a_right"), 3).when(fits("b_right1", "a_right"), 2)
    a_text = F.when(n_a == 2, F.col("a_run1")).otherwise(F.col("a_text"))
    b_text = F.when(n_b == 4, F.col("b_run3")).when(n_b == 3, F.col("b_run2")).when(n_b == 2, F.col("b_run1")).otherwise(F.col("b_text"))
    return found.where((F.col("a_text") != F.col("b_text")) & ~one_to_one(found) & n_a.isNotNull() & n_b.isNotNull()).select(
        "doc_id", "page", "a_line", "a_word", "b_line", "b_word", n_a.alias("n_a"), n_b.alias("n_b"), a_text.alias("a_text"), b_text.alias("b_text"), (a_text == b_text).alias("same")
    )


def conflicts_resolved(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each word of a with the text it has once b is believed: (word's key, text, replaced).

    Of the words of b that stand one to one with it the last in reading order counts; "eg" and "ie", whatever marks
    they have, stay. Boxes decide alone, not how the words look on the page.
    """
    found = pairs(a, b)
    last = found.where(one_to_one(found)).groupBy("doc_id", "page", F.col("a_line").alias("line_ix"), F.col("a_word").alias("word_ix")).agg(F.max_by("b_text", F.struct("b_line", "b_word")).alias("said"))
    stays = F.regexp_replace("text", r"\W", "").isin("eg", "ie")
    text = F.when(F.col("said").isNull() | stays, F.col("text")).otherwise(F.col("said"))
    return a.join(last, WORD, "left").select(*WORD, text.alias("text"), (text != F.col("text")).alias("replaced"))


def penalty(text: Column) -> Column:
    """How unlikely a word looks: a twentieth for each of a sign of per cent after no digit, a double i, a lone m, a digit between letters, a bracket that closes at the start."""
    signs = ("[^0-9]%", "ii", "^m$", "(?i)[a-z][0-9][a-z]", r"^\].")  # fixed values
    return sum((F.when(text.rlike(x), 1).otherwise(0) for x in signs), F.lit(0)) * F.lit(0.05)


def implausible(text: Column, other: Column) -> Column:
    """Whether a word has a digit between letters, or a double i between other letters, and the other reading has not."""
    only = lambda x: text.rlike(x) & ~other.rlike(x)
    return only("(?i)[a-z][0-9][a-z]") | only("(?i)[a-hj-z]ii[a-hj-z]")


def assigned(base: DataFrame, other: DataFrame) -> DataFrame:
    """Each word of other with the one word of base that covers most of it, half at least; ties go to the first in reading order."""
    cover = overlap("b", "a")
    found = meet(base, other, PAGE).where(cover >= 0.5).select(
        "a.doc_id", "a.page", F.col("a.line_ix").alias("line_ix"), F.col("a.word_ix").alias("word_ix"), F.col("b.line_ix").alias("o_line"), F.col("b.word_ix").alias("o_word"), F.col("b.text").alias("o_text"), F.col("b.left").alias("o_left"), cover.alias("cover")
    )
    best = F.max_by(F.struct("line_ix", "word_ix", "o_text", "o_left"), F.struct("cover", -F.col("line_ix"), -F.col("word_ix")))
    return found.groupBy("doc_id", "page", "o_line", "o_word").agg(best.alias("x")).select("doc_id", "page", "o_line", "o_word", "x.*")


def consensus(base: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Each word of base with conf, level and the text that the layers agree on.

    A layer's text for a word is what it has there from left to right, run together. All layers agreeing makes
    100, some 80, none 50; then the text that most layers have replaces it if two or more do and no other as many.
    """
    n = len(others)
    votes = None
    for i, o in enumerate(others):
        v = assigned(base, o).groupBy(*WORD).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_left", "o_line", "o_word", "o_text"))), lambda x: x["o_text"]), "").alias("vote")).withColumn("layer", F.lit(i))
        votes = v if votes is None else votes.unionByName(v)
    counts = votes.groupBy(*WORD, "vote").agg(F.count("*").alias("n"))
    top = counts.groupBy(*WORD).agg(F.max("n").alias("most"), F.max_by("vote", F.struct("n", "vote")).alias("vote"), F.collect_list("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("by"))
    alone = F.size(F.filter("all", lambda x: x == F.col("most"))) == 1
    agree = F.coalesce(F.try_element_at("by", F.col("text")), F.lit(0))
    conf = F.when(agree == n, 100).when(agree > 0, 80).otherwise(50)
    text = F.when((agree == 0) & (F.col("most") >= 2) & alone, F.col("vote")).otherwise(F.col("text"))
    return base.join(top, WORD, "left").select(*WORD, text.alias("text"), conf.cast("long").alias("conf"), (text != F.col("text")).alias("replaced"))


def consensus_stats(voted: DataFrame) -> DataFrame:
    return voted.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("conf") == 100).alias("high"), F.count_if(F.col("conf") == 80).alias("medium"), F.count_if(F.col("conf") == 50).alias("low"), F.count_if("replaced").alias("replaced")
    )
