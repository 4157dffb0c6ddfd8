"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GAP, table

#: Bins (a power of two), low-order bits kept of each, words in a shingle, tries of the probe before the full search.
BINS, BITS, WORDS, TRIES = 256, 8, 5, 16
_ROOM = 63 - (BINS.bit_length() - 1)  # bits of a hash below those that name its bin
#: Parts of the key's range per partition, and how finely the range is cut.
PARTS, ACCURACY = 8, 20_000


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once: a lambda's argument is, a column used twice may not be."""
    return F.transform(F.array(value), use)[0]


def _constants(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of the text's runs of five words; of the whole sequence if it has fewer; none without words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")
    short = lambda x: F.shiftrightunsigned(x, 1)

    def runs(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(short(F.xxhash64(F.lit(WORDS), h)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= WORDS, F.transform(F.slice(h, F.lit(1), F.size(h) - (WORDS - 1)), lambda x, i: short(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WORDS)))))).otherwise(whole)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _probe(at: int, attempt: int) -> int:
    """A rule for the bin to look into for an empty bin, the same for all documents."""
    return random.Random(at * 1_000_003 + attempt).randrange(BINS)


def signature(text: Column) -> Column:
    """An array of BINS numbers: the low-order bits of each bin's least hash, empty bins filled from others; empty without words.

    The top bits of a hash name its bin. The hashes are sorted among one mark for each bin that is above all the
    bin's hashes, so the first of each bin is its least hash, or the mark of an empty bin. An empty bin probes
    others in an order of its own until one holds a value (optimal densification); should the first tries all
    fail, which is likely only where few bins hold values, the first of those by the same kind of rule is taken.
    """
    marks = _constants([((b + 1) << _ROOM) - 1 for b in range(BINS)], "bigint")
    probes = _constants([_probe(i, t) for i in range(BINS) for t in range(TRIES)], "int")
    mark, low = F.lit((1 << _ROOM) - 1), F.lit(2**BITS - 1)
    where = lambda h: F.shiftright(h, _ROOM)

    def first(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (where(x) != where(F.get(h, i - 1))))

    def filled(d: Column) -> Column:  # d: the low-order bits, -1 for an empty bin
        used = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(d, b) >= 0)

        def held(b: Column) -> Column:
            return F.nullif(F.get(d, b), F.lit(-1))

        def one(x: Column, b: Column) -> Column:
            last = F.array_min(F.transform(used, lambda u: F.struct(F.hash(b, u).alias("order"), u.alias("bin"))))["bin"]
            return F.when(x >= 0, x).otherwise(F.coalesce(*(held(F.get(probes, b * TRIES + t)) for t in range(TRIES)), held(last)))

        return F.transform(d, one)

    def dense(h: Column) -> Column:
        return F.transform(first(h), lambda x: F.when(x.bitwiseAND(mark) == mark, F.lit(-1)).otherwise(x.bitwiseAND(low).cast("int")))

    def of(h: Column) -> Column:
        full = _let(F.sort_array(F.concat(h, marks)), lambda s: _let(dense(s), filled))
        return F.when(F.size(h) > 0, full).otherwise(F.array().cast("array<int>"))

    return _let(shingle_hashes(text), of)


def packed(bins: Column) -> Column:
    """A signature as hexadecimal digits, two for each bin."""
    digits = F.split(F.lit(",".join(f"{i:02x}" for i in range(2**BITS))), ",")
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v)), "")


def unpacked(fingerprint: Column) -> Column:
    """The signature that packed() made into a fingerprint."""
    pairs = F.regexp_extract_all(fingerprint, F.lit(r"[0-9a-f]{2}"), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """An estimate of the Jaccard similarity of two texts from their signatures, without the matches that chance makes.

    Two empty signatures are alike (1), an empty one is like no other (0).
    """
    same, chance = F.size(F.filter(a, lambda x, i: x == F.get(b, i))), 2.0**-BITS
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the sorted cuts are less than x, by halving."""
    steps, at = [], 1
    while at <= len(cuts):
        steps.insert(0, at)
        at *= 2
    bounds = _constants(cuts, "bigint")
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) < x), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) if cuts else F.lit(0)


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with _text, not null, and _print, its signature, and _next and _next_print: the text and signature of the row that follows by descending key.

    After the last comes the first. The key's range is cut at quantiles; each part holds its rows in order and,
    at its end, a copy of the first row of the part that follows. Null keys come last; equal keys are ordered by
    their texts' hashes, and a key that several quantiles fall on is cut by these.
    """
    spark = docs.sparkSession
    n = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_key", F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))).withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_hash", F.xxhash64("_text"))
    cuts = sorted(keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], ACCURACY).alias("q")).first()["q"] or [])
    many = {x: m for x, m in Counter(cuts).items() if m > 1}  # fewer than there are cuts
    sub = F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * F.col("_many")).cast("int")
    heavy = F.try_element_at(F.create_map(*(F.lit(y) for x in many.items() for y in x)), F.col("_key")) if many else F.lit(1)
    parted = keyed.withColumn("_many", F.coalesce(heavy, F.lit(1))).withColumn("_part", _below(cuts, F.col("_key")) + F.greatest(F.lit(0), F.least(sub, F.col("_many") - 1))).drop("_many")
    firsts = sorted((r["_part"], r["first"]["_key"], r["first"]["_hash"]) for r in parted.groupBy("_part").agg(F.min(F.struct("_key", "_hash")).alias("first")).collect())  # a row for each part
    before = [(*first, firsts[i - 1][0]) for i, first in enumerate(firsts)]
    ends = spark.createDataFrame(before, "_part int, _first long, _first_hash long, _before int")
    here = F.struct(F.col("_part").alias("p"), F.lit(False).alias("copy"))
    copied = F.when((F.col("_key") == F.col("_first")) & (F.col("_hash") == F.col("_first_hash")), F.array(here, F.struct(F.col("_before").alias("p"), F.lit(True).alias("copy"))))
    placed = parted.join(F.broadcast(ends), "_part").withColumn("_at", F.explode(F.coalesce(copied, F.array(here))))
    placed = placed.select(*docs.columns, "_key", "_hash", "_text", F.col("_at.p").alias("_part"), F.col("_at.copy").alias("_copy"))
    order = Window.partitionBy("_part").orderBy("_copy", "_key", "_hash")
    led = placed.withColumn("_next", F.lead("_text").over(order)).withColumn("_print", signature(F.col("_text")))
    return led.withColumn("_next_print", F.lead("_print").over(order)).where(~F.col("_copy")).drop("_key", "_hash", "_part", "_copy")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, without its text, with the fingerprints of each text and of its edited text, and what they are likened to.

    Adds n_chars, edited (the text whose last half is replaced by as much of the next text), fingerprint,
    edited_fingerprint, near_edited and near_next; columns of docs with these names are replaced. Null texts count
    as empty and have empty fingerprints; one row follows itself if it is alone; repeated rows are rows of their
    own; an empty table gives an empty result.
    """
    new = ("n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    own = [c for c in docs.columns if c != text and c.lower() not in new]
    rows = followed(docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(key).alias("in_key"), F.col(text).alias("in_text")), "in_key", "in_text")
    half = F.floor(F.length("_text") / F.lit(2)).cast("int")
    made = rows.withColumn("edited", F.concat(F.left("_text", F.length("_text") - half), F.left("_next", half))).withColumn("edited_print", signature(F.col("edited")))
    return made.select(
        *(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), F.length("_text").cast("long").alias("n_chars"), "edited", packed(F.col("_print")).alias("fingerprint"), packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
