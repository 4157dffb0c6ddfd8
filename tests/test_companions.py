from pagewright.plans import catalog


def test_every_document_is_given_its_companions(spark, tmp_path):
    ids = [0, 1, 2, 3, 5, 7, 10, 12, 25, 100, 123]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["path"]: r["companions"] for r in catalog.QUERIES["companion_files"](spark, str(tmp_path)).collect()}
    assert got == {f"f{i}.pdf": "|".join(sorted(f"F{j}.hocr" for j in ids if str(j).startswith(str(i)))) for i in ids}
