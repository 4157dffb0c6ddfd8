import time

from pyspark.sql import functions as F

from pagewright.functions import text as T


def test_overlapping_parts_of_odd_texts(spark):
    texts = ["", "a", "aa", "aaaaa", "AnanAN", "a.a.a", "a\\Ea\\E", "\U0001d11ean\U0001d11e\U0001d11e", None, "\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for part in ("a", "aa", "an", "a.a", ".", "\\E", "\U0001d11e", "\n\n"):
        want = [None if t is None else sum(t.lower().startswith(part.lower(), i) for i in range(len(t))) for t in texts]
        assert [r[0] for r in df.orderBy("i").select(T.occurrences(F.col("t"), part, overlapping=True)).collect()] == want, part


def test_long_texts_take_time_in_proportion(spark):
    n = 400_000
    df = spark.range(1).select(F.repeat(F.lit("an"), F.lit(n)).alias("t"))
    began = time.time()
    assert df.select(T.occurrences(F.col("t"), "an", overlapping=True)).first()[0] == n
    assert time.time() - began < 20
