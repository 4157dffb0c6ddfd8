import json

from pagewright.operators import library
from pagewright.plans import catalog

from .harness import duck


def _read(rows):
    """The doc_id of each slot and the postings {token: [(doc_id, page)]}, of blocks in order."""
    rows = sorted(rows, key=lambda r: (r["part"], r["block"]))
    docs = [i for r in rows if r["part"] == "docs" for i in json.loads(r["entries"])]
    index = {}
    for r in rows:
        if r["part"] == "vocab":
            pairs = json.loads(r["entries"])
            assert r["n_pages"] == len(pairs) and r["n_docs"] == len({s for s, _ in pairs}) and pairs == sorted(pairs)
            index.setdefault(r["token"], []).extend((docs[s], page) for s, page in pairs)
    return docs, index


def test_the_index_is_stored_whole_with_new_slots(spark, tmp_path):
    long = "\n".join(f"line{i} of it" for i in range(120))
    texts = [(77, "only"), (7, "x yz yz"), (10, "gone yz"), (2, "Yz " + long), (4, ""), (5, None), (17, "gone"), (-3, "yz"), (-7, "yz yz"), (1, "yz Ꟛ \U00010d50z ΟΔΟΣ"), (None, "yz")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["index_compacted"](spark, str(tmp_path))
    docs, index = _read(got.collect())
    assert docs == [-3, 1, 2, 4, 5, -7, 7, 77]  # those indexed anew come last
    assert index["yz"] == [(-3, 0), (1, 0), (2, 0), (-7, 0), (7, 0)] and index["of"] == [(2, 0), (2, 1), (2, 2)] and index["line119"] == [(2, 2)]
    assert not {"gone", "x", "only"} & set(index)  # 77 loses its only word
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL["index_compacted"])
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want.fetchall())


def test_blocks_and_ranges(spark):
    ids = [(i * i * 31) % 9973 - 500 for i in range(1300)]  # some twice
    rows = [(i, i % 5 == 0, f"all w{i % 3} D{i} " + "\n" * 3 + "end " * (i % 7)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, later boolean, text string").repartition(7)
    out = library.compacted(docs, lambda a: a.where(a.word != 0), block=100, most=300).collect()
    left = sorted(set(ids), key=lambda i: (i % 5 == 0, i))
    docs, index = _read(out)
    assert docs == left and len({r["block"] for r in out}) == -(-len(left) // 100) > 5
    assert index["all"] == [(i, 0) for i in left if i % 5] and index["w1"] == [(i, 0) for i in left if i % 3 == 1] and all(index[f"d{i}"] == [(i, 0)] for i in left)
    assert index["end"] == [(i, 0) for i in left if i % 7 > (i % 5 == 0)]


def test_slots_have_no_gaps(spark):
    rows = [(i, i % 3 == 0) for i in [5, 5, -(1 << 63), (1 << 63) - 1, *range(100, 160), 0]]
    docs = spark.createDataFrame(rows, "doc_id long, later boolean")
    for size in (2, 1000):
        got = {(r["slot"], r["doc_id"]) for r in library.numbered(docs, size).collect()}
        assert got == set(enumerate(sorted({i for i, _ in rows}, key=lambda i: (i % 3 == 0, i))))
    assert not library.numbered(docs.where("doc_id is null")).count()
