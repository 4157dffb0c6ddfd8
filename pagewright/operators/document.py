"""Pages, outlines, annotations, redactions, tables and manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import meet, overlap, shared_area
from ..functions.text import column_name, heading

PAGE = ["doc_id", "page"]


# Pages: every change is a map (doc_id, old, new), joined once to each table that has pages.


def deletion(pages: DataFrame, gone: Column) -> DataFrame:
    """The map after pages are removed; the others close up."""
    new = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return pages.where(~gone).select("doc_id", F.col("page").alias("old"), new.cast("long").alias("new"))


def move(pages: DataFrame, moved: Column, to: int) -> DataFrame:
    """The map after pages are taken out and put in again, together, at a place counted without them."""
    w = Window.partitionBy("doc_id").orderBy("page")
    p = pages.withColumn("_moved", moved).withColumn("_rest", F.sum(F.when(moved, 0).otherwise(1)).over(w) - 1)
    order = F.struct(F.when(F.col("_moved"), F.lit(to) - 0.5).otherwise(F.col("_rest").cast("double")).alias("at"), "page")
    return p.select("doc_id", F.col("page").alias("old"), (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1).cast("long").alias("new"))


def insertion(pages: DataFrame, at: int, count: int) -> DataFrame:
    """The map after blank pages are put in before a place."""
    return pages.select("doc_id", F.col("page").alias("old"), F.when(F.col("page") >= at, F.col("page") + count).otherwise(F.col("page")).alias("new"))


def remapped(table: DataFrame, page_map: DataFrame) -> DataFrame:
    kept = table.join(page_map.withColumnRenamed("old", "page"), PAGE)
    return kept.select(*(F.col("new").alias("page") if c == "page" else F.col(c) for c in table.columns))


# Outlines: (doc_id, node, parent, ord, level, title, page).


def nested(headings: DataFrame) -> DataFrame:
    """Parents by level: the last heading before with a lower level. Levels are few, so each that occurs has a window of its own."""
    levels = sorted(r["level"] for r in headings.select("level").where("level is not null").distinct().collect())
    w = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    above = F.greatest(*(F.when(F.col("level") > k, F.coalesce(F.max(F.when(F.col("level") == k, F.col("node"))).over(w), F.lit(-1))).otherwise(-1) for k in levels), F.lit(-1), F.lit(-1))
    return headings.withColumn("parent", above).withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def split_segments(roots: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, segment, title, first, last): a document cut at the first page of each top-level node; what precedes is front matter."""
    first = roots.where("page is not null").groupBy("doc_id", "page").agg(F.min_by("title", "node").alias("title"))
    lead = page_counts.join(first.where("page = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("page"), F.lit("Front matter").alias("title"))
    w = Window.partitionBy("doc_id").orderBy("page")
    cut = first.unionByName(lead).join(page_counts, "doc_id").where(F.col("page") < F.col("page_count"))
    return cut.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("segment"), "title", F.col("page").alias("first"), (F.coalesce(F.lead("page").over(w), F.col("page_count")) - 1).alias("last"))


def outline_remap(outline: DataFrame, page_map: DataFrame) -> DataFrame:
    """Nodes whose pages are gone are left out; their children go to the nearest ancestor that stays."""
    kept = outline.join(page_map.withColumnRenamed("old", "page"), PAGE, "left").withColumn("stays", F.col("page").isNull() | F.col("new").isNotNull())
    up = kept.select("doc_id", F.col("node").alias("up"), F.col("parent").alias("up_parent"), F.col("stays").alias("up_stays"))
    now = kept
    for _ in range(outline.select("level").distinct().count()):  # no chain of parents is longer, since levels fall
        now = now.withColumn("up", F.col("parent")).join(up, ["doc_id", "up"], "left").withColumn("parent", F.when(F.col("up").isNull() | F.col("up_stays"), F.col("up")).otherwise(F.col("up_parent"))).drop("up", "up_parent", "up_stays")
    return now.where("stays").select("doc_id", "node", "parent", "title", F.col("new").alias("page"))


# Annotations and regions: boxes on pages.


def redacted(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words that no redaction reaches into."""
    hit = meet(words, rects, PAGE).where(shared_area("a", "b") > 0).select("a.doc_id", "a.page", "a.line_ix", "a.word_ix").distinct()
    return words.join(hit, ["doc_id", "page", "line_ix", "word_ix"], "left_anti")


def inside(words: DataFrame, rects: DataFrame, least: float = 0.0) -> DataFrame:
    """Words of which a rectangle covers more than a share, with the rectangle's columns box_id and ord."""
    return meet(words, rects, PAGE).where(overlap("a", "b") > least).select(*(F.col(f"a.{c}") for c in words.columns), "b.box_id", "b.ord")


def reordered(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines in the order of the regions that hold more than half of them; the last such region counts, exclusions drop lines."""
    found = meet(lines, regions, PAGE).where(overlap("a", "b") > 0.5).groupBy("a.doc_id", "a.page", "a.line_ix").agg(F.max_by(F.when(F.col("b.kind") == "exclude", 101).otherwise(F.col("b.ord")), "b.box_id").alias("priority"))
    ranked = lines.join(found, [*PAGE, "line_ix"], "left").withColumn("priority", F.coalesce("priority", F.lit(100))).where("priority <= 100")
    return ranked.select(*PAGE, "line_ix", "priority", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("priority", "line_ix")) - 1).cast("long").alias("new_ix"))


def marks(found: DataFrame) -> DataFrame:
    """Runs of neighbouring words of one line as boxes: (doc_id, page, line_ix, left, top, right, bottom, n)."""
    w = Window.partitionBy(*PAGE, "line_ix").orderBy("word_ix")
    run = found.withColumn("_run", F.col("word_ix") - F.row_number().over(w))
    return run.groupBy(*PAGE, "line_ix", "_run").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("n")).drop("_run")


# Tables.


def table_cells(words: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page, table_ix, row_ix, col_ix, text): words by the first column that holds more than half of them and the row their bottom falls into."""
    col = meet(words, columns, PAGE).where(overlap("a", "b") > 0.5).groupBy("a.doc_id", "a.page", "a.line_ix", "a.word_ix").agg(
        F.min(F.struct("b.table_ix", "b.col_ix")).alias("c"), F.first("a.text").alias("text"), F.first("a.left").alias("left"), F.first("a.bottom").alias("bottom")
    ).select("doc_id", "page", "text", "left", "bottom", "line_ix", "word_ix", "c.*")
    row = col.alias("w").join(rows.alias("r"), [F.col("w.doc_id") == F.col("r.doc_id"), F.col("w.page") == F.col("r.page"), F.col("w.table_ix") == F.col("r.table_ix"), F.col("w.bottom") > F.col("r.above"), F.col("w.bottom") <= F.col("r.below")])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.line_ix", "w.left", "w.word_ix", "w.text"))), lambda x: x["text"]), " ")
    return row.groupBy("w.doc_id", "w.page", "w.table_ix", "r.row_ix", "w.col_ix").agg(text.alias("text"))


def column_bounds(boxes: DataFrame, by: list[str], slack: int = 5) -> DataFrame:
    """Columns from boxes whose extents, with some slack, run into each other: (by, col_ix, left, right)."""
    w = Window.partitionBy(*by).orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("left") - slack > reach + slack), 1).otherwise(0)
    run = boxes.withColumn("_new", new).withColumn("col_ix", F.sum("_new").over(w) - 1)
    return run.groupBy(*by, "col_ix").agg(F.min("left").alias("left"), F.max("right").alias("right"))


# A library's manifest: (path, hash, size, mtime, status).


def manifest_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, hash, status): what a scan changes. New files are pending, changed ones are verified, ones that were missing return, ones not seen go missing; interrupted ones are tried once more."""
    both = known.alias("k").join(seen.alias("s"), F.col("k.path") == F.col("s.path"), "full")
    status = (
        F.when(F.col("k.path").isNull(), "pending").when(F.col("s.path").isNull(), "missing").when(F.col("k.status") == "missing", "returned")
        .when((F.col("k.size") != F.col("s.size")) | (F.col("k.mtime") != F.col("s.mtime")), "changed").when((F.col("k.error") == "interrupted") & ~F.col("k.retried"), "pending").otherwise(F.col("k.status"))
    )
    return both.select(F.coalesce("k.path", "s.path").alias("path"), F.coalesce("s.hash", "k.hash").alias("hash"), status.alias("status"))


def moves(diff: DataFrame) -> DataFrame:
    """(path, moved_from): new paths with the content of a missing one; the first by name."""
    gone = diff.where("status = 'missing'").groupBy("hash").agg(F.min("path").alias("moved_from"))
    return diff.where("status = 'pending'").join(gone, "hash").select("path", "moved_from")


def evicted(files: DataFrame, budget: int, groups: int = 64) -> DataFrame:
    """Files to delete so that the most recently used ones fit a budget: (path, last_used, size).

    Uses are summed by coarse time first, so only the files of one slot are ranked one by one.
    """
    span = files.agg(F.min("last_used").alias("a"), F.max("last_used").alias("b")).first()
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // groups + 1)
    slot = F.floor((F.lit(span["b"] or 0) - F.col("last_used")) / width)
    total, at = 0, groups + 1
    sums = files.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size")).orderBy("slot").collect()
    for r in sums:
        if total + r["size"] > budget:
            at = r["slot"]
            break
        total += r["size"]
    running = F.sum("size").over(Window.partitionBy("_slot").orderBy(F.desc("last_used"), "path"))
    close = files.withColumn("_slot", slot).where(F.col("_slot") == at).withColumn("_sum", running + total).where(F.col("_sum") > budget).select("path", "last_used", "size")
    return close.unionByName(files.where(slot > at).select("path", "last_used", "size"))


def paged(lines: DataFrame, most: int) -> DataFrame:
    """(doc_id, page) of the pages from the first on that together stay within so many characters; the first in any case."""
    p = lines.groupBy(*PAGE).agg(F.sum(F.length("line") + 1).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page"))
    return p.withColumn("upto", upto).where((F.col("upto") <= most) | (F.col("upto") == F.col("n"))).select(*PAGE, "upto")


def companions(documents: DataFrame, data: DataFrame) -> DataFrame:
    """(path, companions): data files (path) of a document's folder whose names begin with its stem.

    A data file's prefixes are few, so the stem meets them by equality.
    """
    folder = lambda p: F.regexp_extract(p, r"^(.*/)?", 0)
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    d = documents.select("path", folder(F.col("path")).alias("folder"), stem.alias("stem"))
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    f = data.select(F.col("path").alias("file"), folder(F.col("path")).alias("folder"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name))), lambda k: F.substring(name, F.lit(1), k))).alias("stem"))
    return d.join(f, ["folder", "stem"]).groupBy("path").agg(F.sort_array(F.collect_list("file")).alias("companions"))


def located(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, node, page, line_ix): nodes of an outline (doc_id, node, title) at the first line of the document that says their title, null where none does."""
    said = lines.groupBy("doc_id", heading(F.col("line")).alias("_said")).agg(F.min(F.struct("page", "line_ix")).alias("at"))
    return outline.withColumn("_said", heading(F.col("title"))).join(said, ["doc_id", "_said"], "left").select("doc_id", "node", "at.page", "at.line_ix")


def sheet_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, row, ref, text): table cells as a sheet's, rows numbered through all tables and pages."""
    row = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "table_ix", "row_ix"))
    return cells.where("text <> ''").withColumn("row", row).select("doc_id", "row", F.concat(column_name(F.col("col_ix")), "row").alias("ref"), "text")
