import pytest

from pagewright.plans import catalog

from .harness import duck


@pytest.mark.parametrize("name", ["index_replaced", "index_compacted"])
def test_documents_without_tokens_and_characters_with_several_lower_cases(spark, tmp_path, name):
    texts = [(77, "only"), (7, "x yz"), (10, "gone"), (1, "ΟΔΟΣ ΣΑΣ. İstanbul"), (2, "οδοσ σασ. istanbul"), (4, ""), (14, "ΟΔΟΣ again and again")]  # 77 loses its only word
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    cols = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(cols).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
