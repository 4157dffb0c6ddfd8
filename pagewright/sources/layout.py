"""A deterministic layout of plain text: pages, lines and words with integer boxes, and altered copies of it as further layers.

All of it is worked out within a document's row, so laying out text shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_PER_LINE, LINES_PER_PAGE = 12, 50
LEFT, TOP, CELL, PITCH, HEIGHT, PAGE_HEIGHT = 20, 30, 10, 20, 16, 1050


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ls, par_id, toks): lines of up to twelve words, numbered through the document."""
    words = F.transform(F.split("text", "\n", -1), lambda x: F.filter(F.split(x, " ", -1), lambda t: t != ""))
    parts = lambda t: F.ceil(F.size(t) / F.lit(WORDS_PER_LINE)).cast("int")
    cut = F.transform(words, lambda t, i: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), parts(t))), lambda k: F.struct(i.cast("long").alias("par_id"), F.slice(t, (k - 1) * WORDS_PER_LINE + 1, WORDS_PER_LINE).alias("toks"))))
    full = F.filter(F.flatten(cut), lambda x: F.size(x["toks"]) > 0)
    return docs.select("doc_id", F.posexplode(full).alias("ls", "x")).select("doc_id", F.col("ls").cast("long").alias("ls"), "x.par_id", "x.toks")


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, word_ix, ls, par_id, text, left, top, right, bottom, conf)."""
    each = lines(docs).select("doc_id", "ls", "par_id", "toks", F.posexplode("toks").alias("word_ix", "text"))
    before = F.aggregate(F.slice("toks", F.lit(1), F.col("word_ix")), F.lit(0), lambda acc, t: acc + F.length(t) + 1)
    left = (LEFT + CELL * before).cast("long")
    line = F.col("ls") % LINES_PER_PAGE
    return each.select(
        "doc_id", F.floor(F.col("ls") / LINES_PER_PAGE).alias("page"), line.alias("line_ix"), F.col("word_ix").cast("long").alias("word_ix"), "ls", "par_id", "text",
        left.alias("left"), (TOP + PITCH * line).alias("top"), (left + CELL * F.length("text")).alias("right"), (TOP + PITCH * line + HEIGHT).alias("bottom"),
        ((31 * F.col("doc_id") + 17 * F.col("ls") + 7 * F.col("word_ix")) % 101).alias("conf"),
    )


def moduli(doc: int, ls: int, word: int, m: int) -> Column:
    return (doc * F.col("doc_id") + ls * F.col("ls") + word * F.col("word_ix")) % m


def words_b(docs: DataFrame) -> DataFrame:
    """Layer B: some words missing, some letters misread, all boxes up to a pixel off."""
    a = words(docs).where(moduli(1, 3, 5, 11) != 0)
    off = (F.col("doc_id") + F.col("word_ix")) % 3 - 1
    return a.withColumns({"text": F.when(moduli(1, 1, 1, 7) == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text")), "left": F.col("left") + off, "right": F.col("right") + off})


def words_c(docs: DataFrame) -> DataFrame:
    """Layer C: every thirteenth word or so far off the page."""
    off = F.when(moduli(1, 1, 1, 13) == 0, 5000).otherwise(0)
    return words(docs).withColumns({"left": F.col("left") + off, "right": F.col("right") + off})


def words_d(docs: DataFrame) -> DataFrame:
    """Layer D: pairs of words run together into one box where a modulus says so."""
    k = F.floor(F.col("word_ix") / 2)
    joined = (F.col("doc_id") + F.col("ls") + k) % 5 == 0
    key = ["doc_id", "page", "line_ix", "ls", "par_id", "top", "bottom"]
    a = words(docs)
    pairs = (
        a.where(joined).groupBy(*key, k.alias("k"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"]), "").alias("text"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("conf").alias("conf"))
        .withColumn("word_ix", F.col("k") * 2)
    )
    return a.where(~joined).unionByName(pairs.select(a.columns))


def words_e(docs: DataFrame) -> DataFrame:
    """Layer E: layer D, and words of eight letters or more split into two to four touching pieces where a modulus says so."""
    n = F.when((F.length("text") >= 8) & ((F.col("doc_id") + F.col("ls") + F.col("word_ix")) % 3 == 0), 2 + (F.col("doc_id") + F.col("word_ix")) % 3).otherwise(1).cast("int")
    size = F.ceil(F.length("text") / n).cast("int")
    cut = words_d(docs).withColumns({"n": n, "size": size}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    last, left = F.col("i") == F.col("n") - 1, F.col("left") + CELL * F.col("i") * F.col("size")
    right = F.when(last, F.col("right")).otherwise(left + CELL * F.col("size"))
    text = F.substring("text", F.col("i") * F.col("size") + 1, F.when(last, F.length("text")).otherwise(F.col("size")))
    return cut.select(*(x.alias(c) for c, x in zip(("text", "left", "right", "word_ix"), (text, left, right, F.col("word_ix") * 4 + F.col("i")))), *(c for c in cut.columns if c not in ("text", "left", "right", "word_ix", "n", "size", "i")))


def chars(docs: DataFrame) -> DataFrame:
    """(word's key, char_ix, ch, left, right, top, bottom): cells of ten pixels with a jitter of up to two."""
    w = words(docs)
    c = w.select("doc_id", "page", "line_ix", "word_ix", "left", "top", "bottom", F.posexplode(F.split("text", "")).alias("char_ix", "ch"))
    jitter = (F.col("char_ix") * 3 + F.col("word_ix")) % 3
    at = F.col("left") + CELL * F.col("char_ix") + jitter
    return c.select("doc_id", "page", "line_ix", "word_ix", F.col("char_ix").cast("long").alias("char_ix"), "ch", at.alias("left"), (F.col("left") + CELL * (F.col("char_ix") + 1)).alias("right"), (F.col("top") + F.ascii("ch") % 5).alias("top"), "bottom")


#: The same in SQL, as common table expressions to put in front of a query: words, words_b, words_c and words_d.
SQL = """
with split_lines as (
  select doc_id, unnest(range(len(l))) as par_id, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
split_words as (
  select doc_id, par_id, unnest(range(len(t))) as wi, unnest(t) as text
  from (select doc_id, par_id, list_filter(string_split(line, ' '), lambda x: x <> '') as t from split_lines)),
lined as (
  select doc_id, par_id, text, wi % 12 as word_ix, dense_rank() over (partition by doc_id order by par_id, wi // 12) - 1 as ls from split_words),
placed as (
  select *, 20 + 10 * coalesce(sum(length(text) + 1) over (partition by doc_id, ls order by word_ix rows between unbounded preceding and 1 preceding), 0)::bigint as "left" from lined),
words as (
  select doc_id, ls // 50 as page, ls % 50 as line_ix, word_ix, ls, par_id, text, "left", 30 + 20 * (ls % 50) as top,
         "left" + 10 * length(text) as "right", 46 + 20 * (ls % 50) as bottom, (31 * doc_id + 17 * ls + 7 * word_ix) % 101 as conf from placed),
words_b as (
  select doc_id, page, line_ix, word_ix, ls, par_id, case when (doc_id + ls + word_ix) % 7 = 0 then replace(text, 'e', 'c') else text end as text,
         "left" + (doc_id + word_ix) % 3 - 1 as "left", top, "right" + (doc_id + word_ix) % 3 - 1 as "right", bottom, conf
  from words where (doc_id + 3 * ls + 5 * word_ix) % 11 <> 0),
words_c as (
  select * replace ("left" + case when (doc_id + ls + word_ix) % 13 = 0 then 5000 else 0 end as "left", "right" + case when (doc_id + ls + word_ix) % 13 = 0 then 5000 else 0 end as "right") from words),
words_d as (
  select doc_id, page, line_ix, word_ix, ls, par_id, text, "left", top, "right", bottom, conf from words where (doc_id + ls + word_ix // 2) % 5 <> 0
  union all
  select doc_id, page, line_ix, (word_ix // 2) * 2, ls, par_id, string_agg(text, '' order by word_ix), min("left"), top, max("right"), bottom, min(conf)
  from words where (doc_id + ls + word_ix // 2) % 5 = 0 group by doc_id, page, line_ix, word_ix // 2, ls, par_id, top, bottom)
"""
