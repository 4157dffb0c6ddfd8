"""Language identification: known words by their log frequency in each language, unseen ones by shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, most_frequent, table, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Bounds of what is broadcast: that many words, and n-grams of each order, over all languages; the rest is joined.
MAX_WORDS, MAX_GRAMS, ORDERS = 50_000, 20_000, (4, 3, 2, 1)
FLUSH, KEPT = 400_000, 200_000
#: Rows share a list of the words to join until it holds that many words, occurrences or rows.
CHUNK_WORDS, CHUNK_HITS, CHUNK_ROWS = 200_000, 1_000_000, 20_000


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def _flush(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, k, n) for lang, c in counts.items() for k, n in c.items()]
    lang, item, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(item, pa.string()), pa.array(n, pa.int64())], names=["lang", "item", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, counts.values())) > FLUSH:
                yield _flush(counts)
                counts = {}
    yield _flush(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for b in batches:
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "item", "n"))):
            c = counts.setdefault(lang, Counter())
            for k in ORDERS:
                for g in grams(word, k):
                    c[f"{k}{g}"] += n
            if sum(map(len, counts.values())) > FLUSH:
                yield _flush(counts)
                counts = {}
    yield _flush(counts)


def _rates(items: list[dict[str, int]], sizes: np.ndarray, langs: list[str]) -> np.ndarray:
    """log((count + 0.5) / size) of each item in each language; a size is total + 0.5 * (distinct items + 1)."""
    counts = np.array([[x.get(lang, 0) for lang in langs] for x in items], dtype=np.float64).reshape(len(items), len(langs))
    return np.log((counts + 0.5) / sizes)


def _rate_columns(langs: list[str], sizes: list[Column]) -> list[Column]:
    """The same as columns r0, r1, ... of a table with a map `by` of counts by language."""
    return [F.log((F.coalesce(F.try_element_at("by", F.lit(lang)), F.lit(0)) + 0.5) / size).alias(f"r{i}") for i, (lang, size) in enumerate(zip(langs, sizes))]


class Model:
    """Bounded tables of log frequencies by language, and where they are not whole, the whole ones as tables (item, r0, r1, ...)."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rates: np.ndarray, grams_at: dict[str, int], gram_rates: np.ndarray, prior: np.ndarray, whole: tuple[DataFrame, DataFrame] | None = None):
        self.langs, self.words, self.word_rates, self.grams_at, self.gram_rates, self.prior, self.whole = langs, words, word_rates, grams_at, gram_rates, prior, whole

    def __getstate__(self) -> dict:
        return self.__dict__ | {"whole": None}

    def parts(self, word: str) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
        """From the longest order to the first of which a bounded n-gram is there: (order, how many, their sum, n-grams to look up)."""
        for n in ORDERS:
            keys = [f"{n}{g}" for g in grams(word, n)]
            at = [k for x in keys if (k := self.grams_at.get(x)) is not None]
            yield n, len(at), self.gram_rates[at].sum(axis=0), [x for x in keys if x not in self.grams_at]
            if at:
                return

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's n-grams of the longest order of which any is known."""
        for n in ORDERS:
            at = [k for g in grams(word, n) if (k := self.grams_at.get(f"{n}{g}")) is not None]
            if at:
                return self.gram_rates[at].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def predict(self, text: str | None, seen: dict[str, int], rows: np.ndarray, free: list[int]) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else ()
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        at = []
        for w in words:
            k = seen.get(w)
            if k is None:
                if free[0] >= len(rows):
                    fixed = len(self.words)
                    for x in [x for x, j in seen.items() if j >= fixed]:
                        del seen[x]
                    if at:  # what was counted so far stays in the sums
                        kept = rows[at].sum(axis=0, dtype=np.float64)
                        rows[fixed] = kept
                        at = [fixed]
                        free[0] = fixed + 1
                    else:
                        free[0] = fixed
                k = free[0]
                rows[k] = self.unseen(w)
                seen[w] = k
                free[0] += 1
            at.append(k)
        total = rows[at].sum(axis=0, dtype=np.float64) + self.prior
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows whose text and language are not null. Counts cover every row; what is broadcast of them is bounded, the rest stays in tables."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    shape = "lang string, item string, n long"
    summed = lambda x: x.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    by_item = lambda x: x.groupBy("item").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    words = written(summed(rows.mapInArrow(_count_words, shape)), "words")
    gram_counts = written(summed(words.mapInArrow(_count_grams, shape)), "grams")
    each_word, each_gram = written(by_item(words), "each_word"), written(by_item(gram_counts), "each_gram")

    def top(each: DataFrame, most: int) -> tuple[list[str], list[dict[str, int]]]:
        best = sorted(most_frequent(each, most).collect(), key=lambda r: (-r["n"], r["item"]))
        return [r["item"] for r in best], [r["by"] for r in best]

    def sizes(counts: DataFrame, distinct: int) -> np.ndarray:
        total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
        return np.array([total.get(x, 0) for x in langs], dtype=np.float64) + 0.5 * (distinct + 1)

    docs_by = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(docs_by)
    order = F.substring("item", 1, 1).cast("int")
    n_words, n_grams = each_word.count(), {r["order"]: r["count"] for r in each_gram.groupBy(order.alias("order")).count().collect()}
    word_sizes = sizes(words, n_words)
    items, by = top(each_word, MAX_WORDS)
    names: list[str] = []
    rates: list[np.ndarray] = []
    gram_sizes: dict[int, np.ndarray] = {}
    for n in ORDERS:
        gram_sizes[n] = sizes(gram_counts.where(order == n), n_grams.get(n, 0))
        g, g_by = top(each_gram.where(order == n), MAX_GRAMS)
        names += g
        rates.append(_rates(g_by, gram_sizes[n], langs))
    whole = None
    if len(items) < n_words or len(names) < sum(n_grams.values()):
        of_order = [F.element_at(F.array(*(F.lit(float(gram_sizes[n][i])) for n in sorted(ORDERS))), order) for i in range(len(langs))]
        whole = (each_word.select("item", *_rate_columns(langs, [F.lit(float(x)) for x in word_sizes])), each_gram.select("item", *_rate_columns(langs, of_order)))
    share = np.array([docs_by[x] for x in langs], dtype=np.float64)
    return Model(langs, {w: i for i, w in enumerate(items)}, _rates(by, word_sizes, langs), {g: i for i, g in enumerate(names)}, np.concatenate(rates), np.log(share / share.sum()) if langs else share, whole)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, without its text, with lang_pred and score, the share of the likeliest language.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Whole texts count,
    however long; every row gets its own result, repeated or not; of equally likely languages the first by name.
    Every word and n-gram seen in training counts as seen: what the bounded tables lack is joined. An empty table
    gives an empty result. Columns of docs named lang_pred or score, in any case, are replaced, others kept
    whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    plain = docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"))
    carried = [f"{c} {t}" for c, t in plain.dtypes if c != "text"]
    shape = ", ".join([*carried, "lang_pred string, score double"])
    out = _joined(plain, model, shared, carried, shape) if model.whole else plain.mapInArrow(lambda x: _predict(shared, x), shape)
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "lang_pred", "score")


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the bounded tables are whole."""
    m = shared.value
    rows = np.zeros((len(m.words) + KEPT, max(1, len(m.langs))), dtype=np.float64)
    if m.words:
        rows[: len(m.words)] = m.word_rates
    seen, free = dict(m.words), [len(m.words)]
    for b in batches:
        got = [m.predict(t, seen, rows, free) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])


def _chunks(shared, bounds: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the sum over its bounded words and the places of all others in a list that the chunk's last row carries."""
    m = shared.value
    chunk = TaskContext.get().partitionId() << 32
    zero, get = np.zeros(len(m.langs)), m.words.get
    kept, letters, sums, places, lack, hits = [], [], [], [], {}, 0

    def rows() -> pa.RecordBatch:
        t = pa.Table.from_batches(kept).combine_chunks()
        n = len(letters)
        return pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns), pa.array([chunk] * n, pa.int64()), pa.array(letters, pa.bool_()), pa.array(sums, pa.list_(pa.float64())),
             pa.array(places, pa.list_(pa.int32())), pa.array([None] * (n - 1) + [list(lack)], pa.list_(pa.string()))],
            names=[*t.schema.names, "chunk", "letters", "head", "places", "lack"],
        )

    for b in batches:
        plain, start = b.select(b.schema.names[:-1]), 0
        for i, t in enumerate(b.column("text").to_pylist()):
            words = LETTERS.findall(t.lower()) if t else ()
            letters.append(any(any(map(str.isalpha, w)) for w in words))
            at = list(map(get, words)) if letters[-1] else []
            other = [lack.setdefault(w, len(lack)) for w, k in zip(words, at) if k is None]
            at = [k for k in at if k is not None]
            sums.append(m.word_rates[at].sum(axis=0) if at else zero)
            places.append(np.array(other, dtype=np.int32))
            hits += len(other)
            if len(lack) >= bounds[0] or hits >= bounds[1] or len(letters) >= bounds[2]:
                kept.append(plain.slice(start, i + 1 - start))
                yield rows()
                kept, letters, sums, places, lack, hits, start, chunk = [], [], [], [], {}, 0, i + 1, chunk + 1
        if start < b.num_rows:
            kept.append(plain.slice(start))
    if letters:
        yield rows()


def _parts(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = shared.value
    for b in batches:
        got = [(w, *x) for w in b.column(0).to_pylist() for x in m.parts(w)]
        word, order, n, head, lack = zip(*got) if got else ((),) * 5
        sums = np.array(head, dtype=np.float64).reshape(len(got), len(m.langs))
        yield pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(order, pa.int32()), pa.array(n, pa.int64()), pa.array(lack, pa.list_(pa.string())), *(pa.array(sums[:, i]) for i in range(len(m.langs)))],
            names=["word", "order", "n", "lack", *(f"r{i}" for i in range(len(m.langs)))],
        )


def _joined(plain: DataFrame, model: Model, shared, carried: list[str], shape: str) -> DataFrame:
    """Where they are not: each chunk's other words meet the whole table of words; those that are not in it, the whole table of n-grams."""
    words, gram_table = model.whole
    r = [f"r{i}" for i in range(len(model.langs))]
    bounds = CHUNK_WORDS, CHUNK_HITS, CHUNK_ROWS
    chunks = written(plain.mapInArrow(lambda x: _chunks(shared, bounds, x), ", ".join([*carried, "chunk long, letters boolean, head array<double>, places array<int>, lack array<string>"])), "chunks")
    lack = chunks.where("lack is not null").select(F.col("chunk").alias("of_chunk"), F.posexplode("lack").alias("k", "word"))
    unseen = lack.select("word").distinct().join(words.select(F.col("item").alias("word")), "word", "left_anti")
    parts = written(unseen.mapInArrow(lambda x: _parts(shared, x), "word string, order int, n long, lack array<string>, " + ", ".join(f"{c} double" for c in r)), "parts")
    found = parts.select("word", "order", F.explode("lack").alias("item")).join(gram_table, "item").select("word", "order", F.lit(1).cast("long").alias("n"), *r)
    by_order = parts.select("word", "order", "n", *r).unionByName(found).groupBy("word", "order").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in r)).where("n > 0")
    longest = by_order.groupBy("word").agg(F.max_by(F.struct(*((F.col(c) / F.col("n")).alias(c) for c in r)), "order").alias("x")).select("word", "x.*")
    rates = lack.join(words.withColumnRenamed("item", "word").unionByName(longest), "word").select("of_chunk", "k", *r)
    names = [c.split(" ", 1)[0] for c in carried]

    def finish(rows: pa.Table, more: pa.Table) -> pa.Table:
        m = shared.value
        known = np.zeros((max(more.column("k").to_numpy(), default=-1) + 1, len(m.langs)))
        for i, c in enumerate(r):
            known[more.column("k").to_numpy(), i] = more.column(c).to_numpy()
        got = []
        for letters, head, places in zip(rows.column("letters").to_pylist(), rows.column("head").to_pylist(), rows.column("places")):
            if not letters:
                got.append(("und", 0.0))
                continue
            at = places.values.to_numpy()
            total = np.array(head) + known[at[at < len(known)]].sum(axis=0) + m.prior
            best = int(np.argmax(total))
            got.append((m.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return pa.table([*(rows.column(c) for c in names), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return chunks.drop("lack").groupBy("chunk").cogroup(rates.groupBy("of_chunk")).applyInArrow(finish, shape)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
