"""What a page's content is, which documents are text, and which pages need recognising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = (
    "largest_image_frac", "invisible_text_chars", "visible_chars", "visible_readable_chars", "body_readable_chars", "printable_vis",
    "control", "control_vis", "path_text_candidates", "image_text_candidates", "longest_broken_run",
)


def char_kinds(words: DataFrame, by: list[str]) -> DataFrame:
    """Counts of printable, private and control characters of words' texts."""
    code = F.ascii("ch")
    c = words.select(*by, F.explode(F.split("text", "")).alias("ch")).select(*by, code.alias("code"))
    inside = lambda a, b: F.col("code").between(a, b)
    return c.groupBy(*by).agg(
        F.count_if(inside(33, 127) | ((F.col("code") >= 161) & ~inside(0xE000, 0xF8FF) & (F.col("code") != 0xFFFD))).alias("printable"),
        F.count_if(inside(0xE000, 0xF8FF)).alias("private"), F.count_if((F.col("code") < 32) | (F.col("code") == 0xFFFD)).alias("control"), F.count("*").alias("chars"),
    )


def document_type(stats: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, type): text, ocr or image by the scores of its pages; pages holds each document's page count."""
    whole = F.col("invisible_text_chars") + F.col("printable_vis") - 5 * F.col("control")
    seen = F.col("printable_vis") - 5 * F.col("control_vis")
    s = stats.groupBy("doc_id").agg(F.sum(whole).alias("whole"), F.sum(seen).alias("seen"), F.count_if(whole >= 100).alias("whole_pages"), F.count_if(seen >= 100).alias("seen_pages"))
    n = F.col("page_count")
    enough = F.coalesce("whole", F.lit(0)) >= n * 100
    kind = F.when(enough & (F.col("seen") >= F.col("whole") * 0.9) & (F.col("seen_pages") >= n / 2), "text").when(enough & (F.col("whole_pages") >= n / 2), "ocr").otherwise("image")
    return pages.join(s, "doc_id", "left").select("doc_id", "page_count", kind.alias("type"))


def predicates() -> dict[str, Column]:
    """Named predicates on a page's statistics."""
    c = F.col
    full, readable = c("largest_image_frac") >= 0.95, c("visible_readable_chars") >= 100
    return {
        "full_page_image": full, "readable": readable, "scan": full & ~readable, "has_ocr_layer": full & (c("invisible_text_chars") >= 100), "broken_run": c("longest_broken_run") >= 3,
        "baked_text": (c("largest_image_frac") >= 0.1) | (c("path_text_candidates") >= 8) | (c("image_text_candidates") >= 8),
        "empty": (c("largest_image_frac") < 0.02) & (c("visible_chars") == 0) & (c("invisible_text_chars") == 0), "real_text": c("body_readable_chars") >= 100,
        "scan_or_unreadable": (full & ~readable) | (c("longest_broken_run") >= 100),
    }


def select_pages(stats: DataFrame, types: DataFrame, mode: str = "autoShallow", trust: bool = False) -> DataFrame:
    """(doc_id, page, recognise) for modes all, none, auto, autoDeep and autoShallow; trust keeps an existing layer."""
    p = predicates()
    whole = F.when(F.col("type") == "text", False).when(F.col("type") == "ocr", not trust).otherwise(True)
    layer = F.when(p["has_ocr_layer"], not trust).otherwise(True)
    deep = F.when(p["broken_run"], True).when(p["scan"], layer).otherwise(p["baked_text"])
    shallow = F.when(~p["scan_or_unreadable"], False).otherwise(layer)
    rule = {"all": F.lit(True), "none": F.lit(False)}.get(mode, F.when(whole, True).otherwise(deep if mode in ("auto", "autoDeep") else shallow))
    return stats.join(types.select("doc_id", "type"), "doc_id", "left").select("doc_id", "page", rule.alias("recognise"))


def needs_recognition(stats: DataFrame) -> DataFrame:
    p = predicates()
    return stats.groupBy("doc_id").agg(F.bool_or(p["baked_text"] | p["broken_run"] | p["scan"]).alias("requires_ocr"))


def page_stats(words: DataFrame) -> DataFrame:
    """Statistics of laid out pages: characters are counted, images and paths follow from the document's number."""
    n = words.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    d, p = F.col("doc_id"), F.col("page")
    hidden = (d + p) % 3 == 0
    return n.select(
        "doc_id", "page", (((d * 7 + p * 3) % 101) / F.lit(100.0)).alias("largest_image_frac"), F.when(hidden, F.col("n")).otherwise(0).alias("invisible_text_chars"),
        F.when(hidden, 0).otherwise(F.col("n")).alias("visible_chars"), F.when(hidden, 0).otherwise(F.col("n") - d % 5).alias("visible_readable_chars"), F.when(hidden, 0).otherwise(F.col("n")).alias("body_readable_chars"),
        F.when(hidden, 0).otherwise(F.col("n")).alias("printable_vis"), ((d + p) % 13).alias("control"), F.when(hidden, 0).otherwise((d + p) % 13).alias("control_vis"),
        ((d + 2 * p) % 11).alias("path_text_candidates"), ((3 * d + p) % 10).alias("image_text_candidates"), ((5 * d + p) % 7).alias("longest_broken_run"),
    )


STATS_SQL = """, page_stats as (
  select doc_id, page, ((doc_id * 7 + page * 3) % 101) / 100.0::double as largest_image_frac, case when (doc_id + page) % 3 = 0 then n else 0 end as invisible_text_chars,
    case when (doc_id + page) % 3 = 0 then 0 else n end as visible_chars, case when (doc_id + page) % 3 = 0 then 0 else n - doc_id % 5 end as visible_readable_chars,
    case when (doc_id + page) % 3 = 0 then 0 else n end as body_readable_chars, case when (doc_id + page) % 3 = 0 then 0 else n end as printable_vis, (doc_id + page) % 13 as control,
    case when (doc_id + page) % 3 = 0 then 0 else (doc_id + page) % 13 end as control_vis, (doc_id + 2 * page) % 11 as path_text_candidates, (3 * doc_id + page) % 10 as image_text_candidates, (5 * doc_id + page) % 7 as longest_broken_run
  from (select doc_id, page, sum(length(text))::bigint as n from words group by doc_id, page)),
types as (
  select doc_id, count(*) as page_count, case when sum(w) >= count(*) * 100 and sum(v) >= sum(w) * 0.9 and count_if(v >= 100) >= count(*) / 2 then 'text'
    when sum(w) >= count(*) * 100 and count_if(w >= 100) >= count(*) / 2 then 'ocr' else 'image' end as type
  from (select doc_id, invisible_text_chars + printable_vis - 5 * control as w, printable_vis - 5 * control_vis as v from page_stats) group by doc_id)
"""
