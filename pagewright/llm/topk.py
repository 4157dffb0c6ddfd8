"""Exact top-k search by integer inner product over an impact-ordered index, a score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_all, table, written

#: Vectors in a block of the index, queries that are broadcast at once, levels of quantised impact, results.
BLOCK, QUERIES, LEVELS, TOP = 8192, 16_384, 32, 5
#: Of a query's norm, the share that lists left closed at first may have; of the product of norms, the impact below zero down to which the others go at first.
CLOSED, CUT = 0.2, 0.015


class Index:
    """Postings of a block: for each dimension the rows in the order of their quantised values, cut into segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        """order: what an index of the same rows, in the order of their ids, found already."""
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[by_id], np.ascontiguousarray(vectors[by_id])
        n, d = self.v.shape
        self.float = self.v.astype(np.float64)
        self.low, self.high = self.float.min(axis=0), self.float.max(axis=0)
        self.width = np.maximum(1, np.ceil((self.high - self.low + 1) / LEVELS))
        levels = ((self.float - self.low) // self.width).astype(np.int16)
        self.order = order = np.argsort(levels, axis=0, kind="stable") if order is None else order
        self.rows = np.ascontiguousarray(order.T, dtype=np.intp)
        self.values = np.take_along_axis(np.ascontiguousarray(self.float.T), self.rows, axis=1)
        self.ends = np.stack([np.searchsorted(levels[self.rows[j], j], np.arange(LEVELS + 1)) for j in range(d)]) if d else np.zeros((0, LEVELS + 1), dtype=int)
        self.norm = np.sqrt((self.float**2).sum(axis=1))
        self.most = np.abs(self.float).max(axis=0)
        self.read = 0  # postings that searches have read

    def search(self, own: int, q: np.ndarray, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the id own; ties to the smaller id. With a bar, only rows that reach it.

        The lists of the highest weights are read first, each from its best segment down to a common cut, which is
        then the most that their other postings add; lists that are not open add the product of the norms at most.
        Where that leaves too many rows that may reach the bar, the rest of these lists follows, then the others.
        Impacts are summed as floats; the margin is far above their error, and the rows that remain are scored exactly.
        """
        n, d = self.v.shape
        f = q.astype(np.float64)
        total = float(np.abs(f) @ self.most)
        v, exactly = (self.float, f) if total < 2**53 else (self.v, q)
        bound, room = np.zeros(n), np.empty(n)
        bound[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = -np.inf
        by_weight = np.argsort(np.abs(f), kind="stable")
        light = int((np.cumsum(f[by_weight] ** 2) <= CLOSED**2 * (f @ f)).sum())
        closed, heavy = by_weight[:light][::-1], by_weight[light:][::-1]
        cut = -CUT * float(np.sqrt(f @ f)) * float(self.norm.max(initial=0))
        up = f[heavy] > 0
        edge = np.floor((cut / f[heavy] - self.low[heavy]) / self.width[heavy]) + ~up
        edge = self.ends[heavy, np.clip(edge, 0, LEVELS).astype(np.int64)]  # segments from there up, or those below it, have impacts above the cut
        above = [(j, e, n, cut) if u else (j, 0, e, cut) for j, e, u in zip(heavy.tolist(), edge.tolist(), up.tolist())]
        below = [(j, 0, e, cut) if u else (j, e, n, cut) for j, e, u in zip(heavy.tolist(), edge.tolist(), up.tolist())]
        others = [(j, 0, n, 0.0) for j in closed.tolist()]
        bound += cut * len(heavy)
        most = float(np.maximum(f * self.low, f * self.high)[closed].sum())
        rest = np.minimum(float(np.sqrt((f[closed] ** 2).sum())) * self.norm, most)
        for postings, left in ((above, rest), (below, rest), (others, 0)):
            for j, a, b, known in postings:
                if b > a:
                    impact = np.multiply(self.values[j, a:b], f[j], out=room[: b - a])
                    impact -= known
                    np.add.at(bound, self.rows[j, a:b], impact)
                    self.read += b - a
            reach = bound + left
            near = np.argpartition(reach, max(0, n - 4 * k))[-4 * k :]
            near = near[reach[near] > -np.inf]
            if len(near) >= k:
                here = int(np.sort(v[near] @ exactly)[-k])
                bar = here if bar is None else max(bar, here)
            may = np.flatnonzero(reach >= bar - 1e-9 * total) if bar is not None else np.flatnonzero(reach > -np.inf)
            if len(may) <= max(8 * k, n // 8):
                break
        exact = (v[may] @ exactly).astype(np.int64)
        if bar is not None:
            may, exact = may[exact >= bar], exact[exact >= bar]
        at = np.lexsort((self.ids[may], -exact))[:k]
        return self.ids[may[at]], exact[at]


def integers(embedding: Column) -> Column:
    """floor(256 * x) of each component as a long; null for a null vector or one with null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


_INDEX = "size int, ids binary, kind string, v binary, orders binary"


def _small(x: np.ndarray) -> np.ndarray:
    """The numbers in the narrowest signed type that holds them."""
    kind = next(k for k in (np.int16, np.int32, np.int64) if not x.size or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
    return x.astype(kind)


def _blocks(most: int):
    """Blocks of vectors of one length, each with the order that its index goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(d: int) -> pa.RecordBatch:
            parts = held.pop(d)
            index = Index(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
            v = _small(index.v)
            cols = ([d], [index.ids.tobytes()], [v.dtype.name], [v.tobytes()], [index.order.astype(np.uint16).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary()))], names=["size", "ids", "kind", "v", "orders"])

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sizes = part.column(1).value_lengths().to_numpy()
                for d in np.unique(sizes).tolist():
                    here = part.filter(pa.array(sizes == d))
                    v = here.column(1).flatten().to_numpy().reshape(here.num_rows, d)
                    held.setdefault(d, []).append((here.column(0).to_numpy(), v))
                    if sum(len(i) for i, _ in held[d]) + 1024 > most:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return run


def _searched(shared, k: int):
    """Each block's k best rows for every query that is broadcast, without those below the k best of the task's blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: dict[int, list[list[int]]] = {d: [[] for _ in ids] for d, (ids, _) in asked.items()}
        for b in batches:
            for row in b.to_pylist():
                ids, d = np.frombuffer(row["ids"], dtype=np.int64), row["size"]
                if d not in asked:
                    continue
                v = np.frombuffer(row["v"], dtype=row["kind"]).astype(np.int64).reshape(len(ids), d)
                index = Index(ids, v, np.frombuffer(row["orders"], dtype=np.uint16).reshape(len(ids), d))
                for at in range(0, len(asked[d][0]), 1024):
                    own, found, scores = [], [], []
                    for q, x, top in zip(asked[d][0][at : at + 1024], asked[d][1][at : at + 1024], best[d][at : at + 1024]):
                        i, s = index.search(int(q), x, k, top[-1] if len(top) == k else None)
                        top[:] = sorted(top + s.tolist(), reverse=True)[:k]
                        own += [int(q)] * len(i)
                        found.append(i)
                        scores.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of vectors of the highest integer inner product.

    All rows are candidates but those with the query's own key; all of them if fewer than k; ties go to the
    smaller key. Vectors that are null or hold null or non-finite components take no part, nor do null keys;
    vectors of another length than the query's are no candidates of it. A key repeated among the queries counts
    once, repeated rows of vectors are candidates each. Other columns are ignored; an empty table gives an empty
    result.

    Each partition cuts its rows into blocks and writes their index once, whatever keys they have; no vector is
    dealt out. Queries come in parts of bounded size, each broadcast to all blocks; where there are several parts,
    the results of each are written.
    """
    spark = vectors.sparkSession
    of = lambda t: t.select(F.col(key).cast("long").alias("id"), integers(F.col(embedding)).alias("v")).where("id is not null and v is not null")
    blocks = written(of(vectors).mapInArrow(_blocks(BLOCK), _INDEX), "index")
    asked = written(of(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    parts = max(1, math.ceil(1.1 * asked.count() / QUERIES))

    def found(part: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # about QUERIES at most
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["v"]), []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r["id"] for r in x]), np.array([r["v"] for r in x], dtype=np.int64).reshape(len(x), d)) for d, x in by.items()})
        return blocks.mapInArrow(_searched(shared, k), "query_id long, vec_id long, score long")

    every = found(0) if parts == 1 else read_all([written(found(i), "found") for i in range(parts)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
