"""N-gram Jaccard join: candidates share prefix tokens under several global orders; links become components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, drop, table, written
from .components import components

#: Words in a shingle, and the similarity from which two sets are linked, as a fraction of whole numbers.
WORDS, NUM, DEN = 5, 3, 4
#: Documents and shingles in a chunk of the first pass, shingles in a bucket, bits of the filter that is broadcast.
CHUNK_DOCS, CHUNK_SHINGLES, BUCKET_SHINGLES, FILTER_BITS = 2048, 1_000_000, 3_000_000, 1 << 24
#: Bits of the parities that bound how far two sets are apart.
PARITIES = 1024
#: The global orders besides that by frequency: each sorts tokens by the bits that its number mixes.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NOBODY = 0xFFFF
#: Rows from which on a group is large, and how many groups may be; the rows of large ones learn their end by a broadcast.
LARGE, LARGEST = 100, 10_000
_P = np.uint64(0x100000001B3 | 1 << 52 | 1 << 45)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers spread over each other; no two numbers become one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's five-word shingles."""
    words = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out = mixed(out * _P + h[k : k + n])
    return np.unique(out)


def identity(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITIES places whether an odd number of a set's tokens fall on it, as 64-bit numbers.

    Tokens that both sets have cancel out, so two sets differ in at least as many tokens as their parities in bits.
    """
    at = np.bincount((tokens >> np.uint64(20)) % np.uint64(PARITIES), minlength=PARITIES) % 2
    return np.packbits(at.astype(bool)).view(np.int64)


_PASS = "chunk long, ix int, id long, n long, same binary, shared long, bucket int, hashes binary, owners binary"


def _packed(h: np.ndarray) -> bytes:
    """Sorted 32-bit numbers by planes of bytes, which compress well."""
    return np.ascontiguousarray(h.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _first_pass(buckets: int):
    """Rows of two kinds: one for each document, and for each chunk and bucket the hashes found there.

    A hash that several documents of a chunk hold is shared for certain: it is counted for them at once and sent
    on but once, for nobody, so a very common shingle comes to a bucket once for each chunk.
    """

    def chunk_rows(first: int, ids: list, sets: list[np.ndarray]) -> list[tuple]:
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        tokens = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = tokens[1:] != tokens[:-1]
        last = np.ones(len(tokens), dtype=bool)
        last[:-1] = new[1:]
        here = np.bincount(owner[~(new & last)], minlength=len(sets))
        who = np.where(new & last, owner, NOBODY)[new].astype("<u2")
        kept = tokens[new]
        at = (kept >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        low = kept & np.uint64(0xFFFFFFFF)
        rows = [(first, i, ids[i], int(sizes[i]), identity(sets[i]), int(here[i]), None, None, None) for i in range(len(sets))]
        ends = np.searchsorted(at, np.arange(buckets + 1))
        for b in range(buckets):
            x, y = ends[b], ends[b + 1]
            if y > x:
                by = np.argsort(low[x:y], kind="stable")
                rows.append((first, None, None, None, None, None, b, _packed(low[x:y][by]), who[x:y][by].tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _PASS.split(", ")]
        ids, sets, first, held = [], [], None, 0

        def out() -> pa.RecordBatch:
            cols = zip(*chunk_rows(first, ids, sets))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            for row, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                first = row if first is None else first
                s = shingles(text)
                ids.append(key)
                sets.append(s)
                held += len(s)
                if len(sets) >= CHUNK_DOCS or held >= CHUNK_SHINGLES:
                    yield out()
                    ids, sets, first, held = [], [], None, 0
        if sets:
            yield out()

    return run


def _shared_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk how many of each document's hashes in this bucket other chunks hold too."""
    hashes = [_unpacked(x) for x in rows["hashes"]]
    owners = [np.frombuffer(x, dtype="<u2") for x in rows["owners"]]
    chunk = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    hit = np.zeros(len(s), dtype=bool)
    hit[order] = shared
    hit &= owner != NOBODY
    key, n = np.unique(chunk[hit].astype(np.int64) * 65536 + owner[hit], return_counts=True)
    at = key // 65536
    ends = np.searchsorted(at, np.arange(len(rows) + 1))
    out = [(int(c), key[x:y].astype("<u2").tobytes(), n[x:y].astype("<u4").tobytes()) for c, x, y in zip(rows["chunk"], ends, ends[1:]) if y > x]
    return pd.DataFrame(out, columns=["chunk", "ix", "n"])


def _sum_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(65536, dtype=np.int64)
    for ix, n in zip(rows["ix"], rows["n"]):
        total[np.frombuffer(ix, dtype="<u2")] += np.frombuffer(n, dtype="<u4")
    at = np.flatnonzero(total)
    return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "ix": at.astype(np.int32), "others": total[at]})


def classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All documents (id, n, same), and the classes (cid, same, id, n) of equal sets that may be linked to another.

    A set can be linked only if three quarters of its shingles are in other documents, which buckets of the
    shingles' hashes find out without sending texts or sets; hashes that meet by chance only add classes.
    """
    size = docs.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    buckets = max(8, math.ceil(size / 6 / BUCKET_SHINGLES))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = written(rows.mapInArrow(_first_pass(buckets), _PASS), "pass")
    found = made.where("bucket is not null").select("bucket", "chunk", "hashes", "owners").groupBy("bucket").applyInPandas(_shared_in_bucket, "chunk long, ix binary, n binary")
    others = found.groupBy("chunk").applyInPandas(_sum_chunk, "chunk long, ix int, others long")
    each = made.where("bucket is null").select("chunk", "ix", "id", "n", "same", "shared")
    told = each.join(others, ["chunk", "ix"], "left").withColumn("may", (F.col("shared") + F.coalesce("others", F.lit(0))) * DEN >= F.col("n") * NUM)
    all_docs = written(told.select("id", "n", "same", "may"), "sizes")
    drop(made)
    may = all_docs.where("n > 0").groupBy("same").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.bool_or("may").alias("may")).where("may")
    return all_docs, written(may.select(F.monotonically_increasing_id().alias("cid"), "same", "id", "n"), "classes")


_HEADS = [f"head{i}" for i in range(len(ORDERS))]
_SET = ["same", "tokens", "bits", *_HEADS]


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cid, same, id, n, tokens, bits, heads) of the wanted classes. A filter of fixed size, broadcast, lets through the texts of
    their least ids, and few others; the join that follows is exact."""
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1))), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
    filter_ = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for r in bits:
        filter_[r["w"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = np.flatnonzero(f[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1))
            for at in range(0, len(hit), 512):
                sets = [shingles(t) for t in b.column(1).take(pa.array(hit[at : at + 512])).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64())), *(pa.array([head(s, o) for s in sets], pa.list_(pa.int32())) for o in ORDERS)], names=_SET)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).select(place.alias("p"), "text")
    shape = "same binary, tokens array<long>, bits array<long>, " + ", ".join(f"{h} array<int>" for h in _HEADS)
    found = rows.mapInArrow(run, shape).join(wanted.select("same"), "same", "left_semi")
    one = found.groupBy("same").agg(*(F.first(c).alias(c) for c in _SET[1:])).join(wanted, "same")
    return written(one.select("cid", "id", "n", *_SET), "sets")


def _prefix(n: Column) -> Column:
    """How many of a set's first tokens, under any order, it takes to meet every partner's."""
    return n - F.ceil(n * NUM / F.lit(DEN)) + 1


def postings(sets: DataFrame) -> DataFrame:
    """(token, cid, n, most, rank): each set's prefix under the order by frequency, without tokens no other set has.

    most is how many of the set's tokens others hold; rank tells how common its tokens are.
    """
    exploded = sets.select("cid", "n", F.explode("tokens").alias("token"))
    df = written(exploded.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    held = exploded.join(df, "token").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"), F.sum(F.log("df")).alias("common"))
    most = F.size("held").cast("long")
    alone = F.col("n") - most
    linked = held.where(most * DEN >= F.col("n") * NUM).withColumn("first", F.slice("held", 1, F.greatest(F.lit(0), _prefix(F.col("n")) - alone).cast("int")))
    out = written(linked.select("cid", "n", most.alias("most"), (F.col("common") / F.col("n")).alias("rank"), F.explode("first.token").alias("token")), "postings")
    drop(df)
    return out


def _reachable(a: str, b: str) -> Column:
    """Whether sizes, and tokens that no other set has, leave the two sets a chance."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = (na + nb) * NUM  # overlap / (na + nb - overlap) >= NUM / DEN
    return (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & (F.least(f"{a}.most", f"{b}.most") * (NUM + DEN) >= need)


def _near_enough(a: str, b: str) -> Column:
    """Whether the bits in which two sets' parities differ leave them a chance."""
    apart = sum((F.bit_count(F.get(f"{a}.bits", F.lit(k)).bitwiseXOR(F.get(f"{b}.bits", F.lit(k)))) for k in range(1, PARITIES // 64)), F.bit_count(F.get(f"{a}.bits", F.lit(0)).bitwiseXOR(F.get(f"{b}.bits", F.lit(0)))))
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (both - apart) * (NUM + DEN) >= both * (2 * NUM)


def head(x: np.ndarray, order: int) -> np.ndarray:
    """A set's prefix under the order that a number mixes, as 32 bits of each token: sets whose prefixes meet have heads that meet."""
    keys = mixed(x ^ np.uint64(order))
    p = len(x) - -(-len(x) * NUM // DEN) + 1
    firsts = np.partition(keys, p - 1)[:p] if p < len(x) else keys
    return (firsts & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DEN >= (len(a) + len(b) - common) * NUM


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            left, right = part.column("x"), part.column("y")
            keep = [linked(left[i].values.to_numpy().view(np.uint64), right[i].values.to_numpy().view(np.uint64)) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def meeting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose prefixes meet under each of the other orders too, and whose parities are near enough."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.struct("n", "bits", *_HEADS).alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    meet = _near_enough("of_a", "of_b")
    for h in _HEADS:
        meet = meet & F.arrays_overlap(f"of_a.{h}", f"of_b.{h}")
    return both.where(meet).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked. Whole sets are fetched only for pairs that every order lets through."""
    x, y = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    left = written(meeting(pairs, sets), "meeting")
    out = written(left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")
    drop(left)
    return out


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect all that is connected, and the components (cid, comp) they make.

    Sets that share a prefix token are first compared with the one among them whose tokens are most common, a
    copy's likely source. What that connects needs no comparing; then every pair that shares a prefix token, is
    not connected yet and may reach the similarity, by the sets' sizes, parities and tokens of their own, is compared, so no component is missed and a group of copies
    makes as many pairs as it has members. Pairs are candidates only if their prefixes meet under every order,
    which is found out before sets are fetched.
    """
    posts = postings(sets)
    pivot = posts.groupBy("token").agg(F.max_by(F.struct("cid", "n", "most"), F.struct("rank", "cid")).alias("pivot"), F.count("*").alias("df")).where("df > 1")
    star = posts.alias("p").join(pivot.select("token", F.col("pivot.*")).alias("q"), "token").where((F.col("p.cid") != F.col("q.cid")) & _reachable("p", "q"))
    pairs = written(star.select(F.least("p.cid", "q.cid").alias("a"), F.greatest("p.cid", "q.cid").alias("b")).distinct(), "stars")
    first = verified(pairs, sets)
    comp = components(first).withColumnRenamed("id", "cid")
    now = posts.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    now = written(now, "postings")
    drop(posts)
    spread = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", F.struct("rank", "cid")).alias("main")).where("low != high")
    still = written(now.join(spread.select("token", "main"), "token").join(sets.select("cid", "bits"), "cid"), "open")
    few, all_ = still.where("comp != main").alias("p"), still.alias("q")
    apart = (F.col("p.comp") != F.col("q.comp")) & ((F.col("q.comp") == F.col("q.main")) | (F.col("p.cid") < F.col("q.cid")))
    more = few.join(all_, F.col("p.token") == F.col("q.token")).where(apart & _reachable("p", "q") & _near_enough("p", "q"))
    rest = more.select(F.least("p.cid", "q.cid").alias("a"), F.greatest("p.cid", "q.cid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = written(rest, "pairs")
    for done in (pairs, now, still):
        drop(done)
    second = verified(rest, sets)
    drop(rest)
    every = first.unionByName(second)
    return every, components(every).withColumnRenamed("id", "cid")


def _looked_up(rows: DataFrame, ends: DataFrame, by: str, n: int) -> DataFrame:
    """rows with the end of their group by, from a row (by, copies, end) for each group. Rows of large groups, of which there
    are LARGEST at most among n rows, are not dealt out: these ends are broadcast."""
    many = F.col("copies") >= max(LARGE, n // LARGEST)
    large = F.broadcast(ends.where(many).select(by, "end", F.lit(True).alias("large")))
    told = rows.join(large, by, "left")
    rest = told.where("large is null").drop("end", "large").join(ends.where(~many).select(by, "end"), by)
    return told.where("large").drop("large").unionByName(rest)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs.

    Sets of five-word shingles, letters A-Z in lower case; fewer words make one shingle. Two documents are linked
    from a Jaccard similarity of 0.75 on; component_id is the least id that links reach. Null and empty texts
    have no shingles and are linked with nothing; equal sets are one class, so copies cost a row each; repeated
    rows are copies; a null key is linked like others and is never the least, unless it is alone. Whole texts
    count, however long. Other columns are ignored whatever their names; keys are whole numbers. An empty table
    gives an empty result.
    """
    all_docs, wanted = classes(docs, key, text)
    sets = _sets(docs, key, text, wanted)
    _, comp = links(sets)
    n = all_docs.count()
    of = written(sets.select("cid", "same", "id").join(comp, "cid").select("same", "id", "comp"), "members")
    drop(sets)
    least = written(of.groupBy("comp").agg(F.min("id").alias("end"), F.count("*").alias("copies")), "least")
    linked_ = _looked_up(of.select("same", "comp"), least, "comp", n).select("same", "end")
    own = all_docs.where("n > 0").groupBy("same").agg(F.min("id").alias("own"), F.count("*").alias("copies"))
    ends = written(own.join(linked_, "same", "left").select("same", "copies", F.coalesce("end", "own").alias("end")), "ends")
    full = _looked_up(all_docs.where("n > 0"), ends, "same", n)
    full = full.select("id", F.col("n").alias("n_shingles"), F.col("end").alias("component_id"))
    return full.unionByName(all_docs.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
