import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pagewright.llm import bpe, quality, secrets  # noqa: E402

from .test_mixing import brute_targets  # noqa: E402
from .test_ngram_join import sets_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        tables.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(t.columns == cols for t in tables[:-1])
    ids = [[r["doc_id"] for r in t.select("doc_id").collect()] for t in tables]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids[0]) - set(ids[1])
    assert gone and not any(labels.get(i) == 1 for i in gone) and quality.THRESHOLD == 0.3
    rows = [(r["doc_id"], r["text"]) for r in tables[1].select("doc_id", "text").collect()]
    kept, s = set(ids[2]), sets_of(rows)
    near = lambda a, b: 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and s[a]
    stay = [i for i, (k, _) in enumerate(rows) if k in kept]
    assert not any(near(a, b) for a in stay for b in stay if a < b)
    assert all(any(near(a, b) for b in range(len(rows)) if b != a) for a, (k, _) in enumerate(rows) if k not in kept)
    assert ids[2] and sorted(ids[3]) == sorted(ids[2])
    assert sum(len(r["spans"]) for r in secrets.scan(tables[3]).collect()) == 0
    size = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in tables[3].collect()}
    want = {}
    for src, n in size.values():
        want[src] = want.get(src, 0) + n
    target, taken = brute_targets(want), dict.fromkeys(want, 0)
    for i in ids[4]:
        taken[size[i][0]] += size[i][1]
    assert all(abs(taken[x] - target[x]) <= max(2, 0.02 * target[x]) for x in want)
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        pytest.importorskip("tokenizers")
        import tokenizers

        lib = tokenizers.Tokenizer.from_str(f.read())
    texts = {r["doc_id"]: r["text"] for r in tables[3].collect()}
    assert sorted(ids[5]) == sorted(ids[4])
    for r in tables[5].limit(30).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names; and an empty table."""
    good = spark.read.parquet(f"{SF}/documents.parquet")
    keep = [r["text"] for r in good.where("n_chars > 300").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").limit(12).collect()]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(keep)] + [(100, keep[0], None, None, None), (100, keep[0], None, None, None), (None, None, None, None, None), (101, "", "en", "s0", 0), (102, " ".join(keep) * 20, "en", "s0", 1)]
    df = spark.createDataFrame(rows, good.schema).selectExpr("*", "'own score' as score", "'own copies' as copies", "'own size' as size", "'x' as source_key", "'y' as in_0", "1 as pagewright_text", "2 as ids_")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and all(r["score"] == "own score" and r["copies"] == "own copies" and r["size"] == "own size" for r in got)
                docs = spark.createDataFrame(got, docs.schema)
            if name == "quality classifier":
                assert len(got) >= min(13, docs.count())
            if name == "n-gram Jaccard join":
                assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)
