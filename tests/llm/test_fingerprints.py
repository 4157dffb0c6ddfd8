import hashlib
import struct

import xxhash
from pyspark.sql import functions as F

from pagewright.llm import fingerprints as fp


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    out = [(i * 3, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(5 + i * 6))) for i in range(40)]
    return out + [(500, None), (501, ""), (502, "é 漢 one"), (503, "é 漢 one"), (504, "😀a" * 1001), (505, "long word " * 20_000)]


def test_edited_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, edited string")
    got = {r["doc_id"]: r for r in fp.edited_pairs(df.repartition(3)).collect()}
    assert len(got) == len(data)
    texts = [t or "" for _, t in sorted(data, reverse=True)]
    for (i, _), t, after in zip(sorted(data, reverse=True), texts, texts[1:] + texts[:1]):
        r, half = got[i], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r["n_chars"], hashlib.sha256(r["edited"].encode()).digest()) == (len(t), hashlib.sha256(edited.encode()).digest())
        assert abs(r["near_edited"] - jaccard(t, edited)) < 0.15 and abs(r["near_next"] - jaccard(t, after)) < 0.15
    assert got[502]["fingerprint"] == got[503]["fingerprint"] and got[500]["fingerprint"] == got[501]["fingerprint"] == ""
    assert got[501]["near_next"] == 1.0 and got[503]["near_next"] == 1.0


def test_fingerprints_pack_and_unpack(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").select(fp.signature(F.col("text")).alias("s"))
    for r in df.select("s", fp.unpacked(fp.packed(F.col("s"))).alias("u"), fp.packed(F.col("s")).alias("p")).collect():
        assert r["s"] == r["u"] and len(r["s"]) in (0, fp.BINS) and all(0 <= x < 256 for x in r["s"]) and len(r["p"]) == 2 * len(r["s"])


def brute_signature(text):
    """Bins of the top bits, the least hash of each, its low bits; an empty bin takes the first bin of its probes that holds one."""
    signed = lambda h: struct.pack("<Q", h)
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in (text or "").lower().split()]
    runs = []
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(signed(w), seed=h)
        runs.append(h >> 1)
    bins = {}
    for h in runs:
        bins[h >> 55] = min(h, bins.get(h >> 55, h))
    out = []
    for b in range(fp.BINS):
        held = b if b in bins else next((p for t in range(fp.TRIES) if (p := fp._probe(b, t)) in bins), None)
        out.append(None if held is None else bins[held] & 255)
    return out


def test_signature_equals_brute_force(spark):
    texts = [" ".join(f"w{(i * 31 + k * k) % 1009}" for k in range(n)) for i, n in enumerate((60, 200, 600, 3000))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(fp.signature(F.col("text"))).collect()]
    for t, bins in zip(texts, got):
        want = brute_signature(t)
        assert all(w is None or w == g for w, g in zip(want, bins)) and sum(w is None for w in want) < 140
    assert None not in brute_signature(texts[-1])


def test_heavy_keys_are_cut(spark):
    data = [(7, f"text {i} " + "x" * (i % 9)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(9, "first"), (3, "low")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = fp.edited_pairs(df.withColumn("own", F.col("text"))).collect()
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = {t: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(order, order[1:] + order[:1])}
    assert {r["own"]: r["edited"] for r in got} == want and len(got) == len(data)
    parts = fp.followed(df, "doc_id", "text")
    assert parts.count() == len(data)


def test_alone_empty_and_null_keys(spark):
    schema = "doc_id long, text string"
    assert fp.edited_pairs(spark.createDataFrame([], schema)).count() == 0
    one = fp.edited_pairs(spark.createDataFrame([(1, "a b c d e f")], schema)).first()
    assert one["edited"] == "a b c a b c"[:6] + "a b c"
    some = fp.edited_pairs(spark.createDataFrame([(None, "x"), (2, "ab"), (2, "ab"), (1, "cd")], schema)).collect()
    assert sorted(r["edited"] for r in some) == ["aa", "ac", "cx", "x"]
