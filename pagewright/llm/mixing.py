"""Mixing sources to target weights by fitting a subset sum to each source's budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SALTS = 256


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget, or as near as can be.

    A proportional share of each length comes first, then the longest that fit; bounded-knapsack dynamic
    programming spends the rest, which by then is below a few times the longest length.
    """
    order = np.argsort(-lengths, kind="stable")
    w, n = lengths[order].astype(object), counts[order].astype(object)
    total = int(sum(a * b for a, b in zip(w, n)))
    budget = max(0, min(int(budget), total))
    if not total or not budget:
        return np.zeros(len(lengths), dtype=np.int64)
    take = [int(b * budget // total) for b in n]
    rest = budget - sum(a * b for a, b in zip(w, take))
    room = max(2 * int(w[0]), 4096)
    for i, a in enumerate(w):
        if rest <= room:
            break
        more = int(min(n[i] - take[i], (rest - room // 2) // a))
        take[i] += max(0, more)
        rest -= max(0, more) * a
    rest = int(rest)
    cap = rest + int(w[-1])  # one more of the shortest may come nearer than stopping short
    reach = np.zeros(cap + 1, dtype=bool)
    reach[0] = True
    by = np.full(cap + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i, a in enumerate(w):
        left, part = min(int(n[i] - take[i]), cap // int(a)), 1
        while left > 0 and not reach[rest]:  # the count in powers of two
            k = min(part, left)
            step = k * int(a)
            left, part = left - k, part * 2
            if step > cap:
                continue
            new = np.flatnonzero(reach[:-step] & ~reach[step:]) + step
            reach[new] = True
            by[new] = len(items)
            items.append((i, k))
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest), axis=0)])
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(w[i])
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = take
    return out


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = min(int(target // size), MAX_REPEATS)
    budget = 0 if whole == MAX_REPEATS else int(round(target - whole * size))
    extra = fit_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), budget)
    return pd.DataFrame({"source_key": rows["source_key"], "size": rows["size"], "whole": whole, "extra": extra})


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with each source's target in words.

    Sources in the order of code points, null last, weigh `weights`, repeating. They share the total by weight;
    none goes above `most` times its size, and what that leaves is shared again by weight among the others.
    Ranks come from a range partitioning and each level of sharing is one aggregate, so the number of sources
    is not bounded by the driver.
    """
    last = F.col("source").isNull()
    dealt = written(sizes.repartitionByRange(8, last, F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before, at = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # eight rows at most
        before += [F.lit(r["part"]), F.lit(at)]
        at += r["count"]
    offset = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1 + offset
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = written(dealt.select("source", "source_size", weight.alias("weight")), "weights")
    cap = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total[0] or 0) / total[1] if total[1] else 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        r = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not r[2] or r[0] == full:
            break
        full, level = r[0], ((total[0] or 0) - r[1]) / r[2]
    return ranked.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", key: str = "doc_id", seed: int = 17, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix holds the document, 0 to 3).

    Each document is taken as often as its source's size goes into the target; which documents come once more
    is a subset-sum fit over the source's counts by exact length, and among those of one length the seeded hash
    of the key decides. Columns of docs with the names size, source_size, target or copies, in any case, are
    replaced, others kept whatever their names. Whole texts are counted, however long. Null text has size 0 and is never taken; a null source is a source of its own; of repeated rows each counts;
    equal hashes are told apart by the key and then arbitrarily, with the same number taken. An empty table
    gives an empty result. A group of one source and length is dealt over 256 salts, so no group meets in one
    task.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    size = words_in(F.col("text")) if size is None else size
    hashed = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    keyed = docs.select(
        *(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), size.alias("size"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source_key"),
        F.col(key).cast("string").alias("_key"), hashed.alias("_hash"), F.pmod(hashed, F.lit(SALTS)).cast("int").alias("_salt"),
    )
    salted = written(keyed.groupBy("source_key", "size", "_salt").agg(F.count("*").alias("n")), "lengths")
    lengths = salted.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    totals = lengths.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    named = totals.select(F.when(F.col("source_key") != "", F.substr("source_key", F.lit(2))).alias("source"), "source_size")
    targets = source_targets(named, weights).select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"), "source_size", "target")
    targets = written(targets, "targets")
    fits = (
        lengths.where("size > 0").join(targets, "source_key").groupBy("source_key")
        .applyInPandas(_fit_source, "source_key string, size long, whole long, extra long")
    )
    fits = written(fits, "fits")
    upto = Window.partitionBy("source_key", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        salted.where("size > 0").join(fits, ["source_key", "size"])
        .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .select("source_key", "size", "_salt", "whole", F.least("n", F.greatest(F.lit(0), F.col("extra") - F.col("before"))).alias("share"))
    )
    nth = F.row_number().over(Window.partitionBy("source_key", "size", "_salt").orderBy("_hash", "_key"))
    copies = F.coalesce(F.col("whole") + F.when(nth <= F.col("share"), 1).otherwise(0), F.lit(0))
    return (
        keyed.join(written(shares, "shares"), ["source_key", "size", "_salt"], "left").withColumn("copies", copies)
        .join(targets, "source_key", "left").select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "size", "source_size", "target", "copies")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("_size"))
    mixed = mix(written(docs, "sizes"), size=F.col("_size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
