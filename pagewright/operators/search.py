"""Search in words and in a library of pages: phrases, occurrences, postings, ranks, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens, trimmed_edges

READING = ["line_ix", "word_ix"]


def _page() -> Window:
    return Window.partitionBy("doc_id", "page").orderBy(*READING)


def phrase_starts(words: DataFrame, phrase: str) -> DataFrame:
    """Words at which a phrase is found in the words that follow, joined by blanks; matches may overlap.

    The first word must hold the phrase's first, and the joined words the phrase; case is ignored.
    """
    parts = phrase.lower().strip().split(" ")
    n = len(parts)
    near = F.collect_list(F.lower("text")).over(_page().rowsBetween(Window.currentRow, n - 1))
    run = words.withColumn("_near", near).withColumn("ix", F.row_number().over(_page()) - 1)
    return run.where((F.size("_near") == n) & F.get("_near", F.lit(0)).contains(parts[0]) & F.array_join("_near", " ").contains(phrase.lower().strip())).drop("_near")


def phrase_occurrences(words: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, page, occurrences): matches from left to right that share no word."""
    n = len(phrase.lower().strip().split(" "))
    at = phrase_starts(words, phrase).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("ix")).alias("at"))
    counted = F.aggregate("at", F.struct(F.lit(-1).alias("free"), F.lit(0).cast("long").alias("n")), lambda a, i: F.when(i >= a["free"], F.struct((i + n).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    return at.select("doc_id", "page", counted.alias("occurrences"))


def whole_words(words: DataFrame, term: str, match_case: bool = False) -> DataFrame:
    """Words at which a term's words are all found, without what is neither letter nor digit at their edges."""
    parts = term.split(" ") if match_case else term.lower().split(" ")
    plain = F.regexp_replace("text", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "") if match_case else trimmed_edges(F.col("text"))
    w = words.withColumn("_plain", plain)
    hit = F.col("_plain") == parts[0]
    for k, x in enumerate(parts[1:], 1):
        w = w.withColumn(f"_{k}", F.lead("_plain", k).over(_page()))
        hit = hit & (F.col(f"_{k}") == x)
    return w.where(hit).select(words.columns)


def postings(pages: DataFrame) -> DataFrame:
    """(token, doc_id, page) of (doc_id, page, text), each once; one pass, no shuffle."""
    return pages.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), "doc_id", "page")


def query(index: DataFrame, text: str) -> DataFrame:
    """(doc_id, pages, n_pages): documents with pages that hold all words of the query, those with most pages first."""
    asked = sorted({t for t in "".join(c if c.isalnum() else " " for c in text.lower()).split() if len(t) >= 2})
    if not asked:
        return index.select("doc_id", F.array("page").alias("pages"), F.lit(0).cast("long").alias("n_pages")).limit(0)
    page = index.where(F.col("token").isin(asked)).groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    return page.groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"), F.count("*").alias("n_pages")).orderBy(F.desc("n_pages"), "doc_id")


def page_texts(words: DataFrame) -> DataFrame:
    line = words.groupBy("doc_id", "page", "line_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"]), " ").alias("line"))
    return line.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]), "\n").alias("text"))


def snippet(text: Column, term: str, around: int = 70) -> Column:
    """The text around a term's first place, cut with ellipses; its start if it isn't there."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + len(term) - 1 + around)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 2 * around))


def top_matches(found: DataFrame, lines: DataFrame, most: int = 50) -> DataFrame:
    """The first matches by document and place with their lines, and how many there are in all."""
    total = found.groupBy().agg(F.count("*").alias("total"))
    first = found.orderBy("doc_id", "page", "line_ix", "word_ix").limit(most)
    return first.join(lines, ["doc_id", "page", "line_ix"]).join(F.broadcast(total)).select("doc_id", "page", "line_ix", "word_ix", "line", "total", (F.col("total") > most).alias("truncated"))
