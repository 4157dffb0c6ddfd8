"""A library of files: listings, hits, its index, names and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lower_word, title_of
from ..sources import columns

#: Documents and pages of each that a list of hits shows; recent files.
HIT_DOCS, HIT_PAGES, RECENT = 20, 4, 5
#: Slots of a block of an index, bytes of text that are indexed at once; documents of a range of doc_id that is numbered apart, and how many such ranges there are at most.
BLOCK, PART = 65536, 2 << 20
RANGE, RANGES = 1024, 256


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def listed(entries: DataFrame, by: Column, descending: bool = False) -> DataFrame:
    """entries with their folder and their place in it: by a key, one way or the other, then always by ascending title and path."""
    order = by.desc_nulls_first() if descending else by.asc_nulls_last()
    w = Window.partitionBy("folder").orderBy(order, title_of(F.col("rel_path")), "rel_path", "doc_id")
    return entries.withColumn("folder", folder_of(F.col("rel_path"))).withColumn("place", F.row_number().over(w).cast("long"))


def filtered(entries: DataFrame, words: str, folder: str = "") -> DataFrame:
    """Entries whose path has the words in it, whatever their case; without words, those right in the folder."""
    words = words.strip().lower()
    return entries.where(F.lower("rel_path").contains(words) if words else folder_of(F.col("rel_path")) == folder)


def recent(entries: DataFrame, most: int = RECENT) -> DataFrame:
    return entries.where("last_opened > 0").orderBy(F.desc("last_opened"), "doc_id").limit(most)


def ranked_hits(hits: DataFrame) -> DataFrame:
    """Of (doc_id, page, n) the documents with the most hits, and of each its first pages with any: (doc_id, total, page, n)."""
    of = hits.where("n > 0")
    best = of.groupBy("doc_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "doc_id").limit(HIT_DOCS)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return of.join(F.broadcast(best), "doc_id").withColumn("nth", nth).where(F.col("nth") <= HIT_PAGES).select("doc_id", "total", "page", "n")


def replaced(postings: DataFrame, renewed: DataFrame, out: DataFrame) -> DataFrame:
    """An index of (token, doc_id, page) after documents were indexed anew and others removed.

    out has the doc_id of all of them, also of those that have no token any more; renewed the new postings.
    """
    return postings.join(out.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(renewed.select(postings.columns))


def numbered(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """docs (doc_id, later, ...) with slot, from 0 on without gaps: by doc_id, those that came later after all others. Rows that share a doc_id share a slot.

    Ranges of doc_id are numbered apart, then moved on by what lies before them. Approximate quantiles only choose where ranges end. doc_id must not be null.
    """

    def ranges(of: DataFrame) -> list[int]:
        n = min(RANGES, of.count() // size + 1)
        return sorted({min(int(x), (1 << 63) - 1) for x in of.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []

    def at(cuts: list[int], first: int = 0) -> Column:
        if not cuts:
            return F.lit(first)
        mid = len(cuts) // 2
        return F.when(F.col("doc_id") < cuts[mid], at(cuts[:mid], first)).otherwise(at(cuts[mid + 1 :], first + mid + 1))

    old, new = ranges(docs.where(~F.col("later"))), ranges(docs.where("later"))
    ranged = docs.withColumn("_range", F.when(F.col("later"), at(new, len(old) + 1)).otherwise(at(old)))
    sizes = ranged.groupBy("_range").agg(F.count_distinct("doc_id").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of as many rows as there are ranges
    nth = ranged.withColumn("_nth", F.dense_rank().over(Window.partitionBy("_range").orderBy("doc_id")) - 1)
    return nth.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("slot", F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def _parts(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (slot, later, doc_id, text) in parts of most bytes of text, or one slot: each of slots that follow one another, of one block, all later or none; all rows of a slot in one part."""
    kept, last, late, size = [], None, None, 0
    joined = lambda x: pa.Table.from_batches(x).combine_chunks().to_batches()[0]
    for b in batches:
        start = 0
        for i, (slot, later, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.fill_null(pc.binary_length(b.column(3)), 0).to_pylist())):
            if last is not None and slot != last and (slot != last + 1 or later != late or slot % block == 0 or size + n > most):
                yield joined([*kept, b.slice(start, i - start)])
                kept, start, size = [], i, 0
            last, late, size = slot, later, size + n
        kept.append(b.slice(start))
    if last is not None:
        yield joined(kept)


def compacted(docs: DataFrame, renewed: Callable[[columns.Words], columns.Words], block: int = BLOCK, most: int = PART) -> DataFrame:
    """The index of the documents that are left, as it is stored: (part, token, block, n_docs, n_pages, entries).

    docs is (doc_id, later, text): documents that were removed aren't in it; those that are later were indexed anew, from the words that renewed makes of theirs.
    Documents get new slots without gaps (see numbered). Both parts come in blocks of slots, so that no row grows with the library:
    'docs' has in entries the doc_id of each of the block's slots, in order, also of documents without tokens ([4,9,11]);
    'vocab' the token's [slot, page], by slot and page ([[0,2],[5,0]]), with the number of its documents and of its pages in the block.
    A token has no row where no document that is left has it. Tokens are words of two characters at least, each character in lower case.
    """
    slots = numbered(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, block, most):
            slot = part.column(0).to_numpy()
            a = columns.words(part.column(2), part.column(3))
            a = renewed(a) if part.column(1)[0].as_py() else a
            keep = pc.greater_equal(pc.utf8_length(a.text), 2).to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            each = a.text.filter(pa.array(keep)).dictionary_encode()
            lower = pa.array(map(lower_word, each.dictionary.to_pylist()), pa.string()).dictionary_encode()
            code = lower.indices.to_numpy()[each.indices.to_numpy()].astype(np.int64)
            page, at = a.page[keep], slot[a.row[keep]] - slot[0]
            n_at, n_page = int(at.max()) + 1, int(page.max()) + 1
            found = np.unique((code * n_at + at) * n_page + page)
            doc, page = found // n_page, found % n_page
            token, at = doc // n_at, doc % n_at + slot[0]
            first = np.flatnonzero(np.diff(token, prepend=-1))
            pair = pc.binary_join_element_wise(pc.cast(pa.array(at), pa.string()), pc.cast(pa.array(page), pa.string()), ",")
            yield pa.RecordBatch.from_arrays([
                lower.dictionary.take(pa.array(token[first])), pa.array(np.full(len(first), slot[0] // block)), pa.array(np.add.reduceat((np.diff(doc, prepend=-1) != 0).astype(np.int64), first)),
                pa.array(np.diff(first, append=len(token))), pa.array(at[first]), pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(token)), pa.int32()), pair), "],["),
            ], names=["token", "block", "n_docs", "n_pages", "first", "pairs"])

    runs = slots.select("slot", "later", "doc_id", "text").mapInArrow(work, "token string, block long, n_docs long, n_pages long, first long, pairs string")
    runs = runs.repartition("token", "block")  # a single run is a narrower row than a list that a task would gather of its own runs
    in_order = lambda by, x: F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda r: r[x].cast("string"))
    vocab = runs.groupBy("token", "block").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_pages").alias("n_pages"), F.concat(F.lit("[["), F.array_join(in_order("first", "pairs"), "],["), F.lit("]]")).alias("entries"))
    left = slots.select("slot", "doc_id").distinct().groupBy(F.floor(F.col("slot") / block).alias("block"))
    listed = left.agg(F.count("*").alias("n_docs"), F.lit(None).cast("long").alias("n_pages"), F.concat(F.lit("["), F.array_join(in_order("slot", "doc_id"), ","), F.lit("]")).alias("entries"))
    out = ["part", "token", "block", "n_docs", "n_pages", "entries"]
    return listed.withColumns({"part": F.lit("docs"), "token": F.lit("")}).select(out).unionByName(vocab.withColumn("part", F.lit("vocab")).select(out))


def unreferenced(artifacts: DataFrame, entries: DataFrame) -> DataFrame:
    """Artifacts (hash, ...) that no entry refers to."""
    return artifacts.join(entries.select("hash").distinct(), "hash", "left_anti")


def free_names(names: DataFrame) -> DataFrame:
    """(folder, name, ord) with free, the name each gets if they come in the order of ord: its own, or the next with a number from 2 on before its ending."""
    nth = F.row_number().over(Window.partitionBy("folder", "name").orderBy("ord"))
    stem, end = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^.+?(\.[^.]*)?$", 1)
    return names.withColumn("nth", nth).withColumn("free", F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("nth"), F.lit(")"), end))).drop("nth")


def batch_status(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """files (path, output, text_like) with what a batch does with each: nothing where output and file are the same, where the output exists or where it has no text."""
    there = outputs.select("output").distinct().withColumn("exists", F.lit(True))
    status = F.when(F.col("path") == F.col("output"), "sameAsInput").when(F.col("exists"), "exists").when(~F.coalesce("text_like", F.lit(False)), "imageBased").otherwise("extracted")
    return files.join(there, "output", "left").select(*files.columns, status.alias("status"))
