import json

from pyspark.sql import functions as F

from pagewright.operators import document
from pagewright.streaming import results


def test_pages_settle_once_whatever_the_order(spark, tmp_path):
    folder, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    write = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "page", "kind", "text"), r))) for r in rows))
    write("a.json", [(1, 2, "done", "two"), (1, 0, "progress", None), (1, 0, "done", "zero"), (1, 9, "done", "not asked for")])
    results.collect_pages(results.page_stream(spark, folder), target, mark)
    write("b.json", [(1, 2, "done", "two"), (1, 1, "error", "bad")])
    results.collect_pages(results.page_stream(spark, folder), target, mark)  # goes on where it stopped
    stored = spark.read.parquet(target)
    assert stored.count() == 4
    expected = spark.createDataFrame([(1, p) for p in range(4)], "doc_id long, page long")
    got = {r["page"]: (r["text"], r["status"]) for r in results.settled(expected, stored).collect()}
    assert got == {0: ("zero", "done"), 1: ("", "failed"), 2: ("two", "done"), 3: ("", "missing")}


def test_ingest_merges_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"path": "a", "hash": "1", "size": 1, "mtime": 1}')
    state = {"m": spark.createDataFrame([("b", "2", 1, 1, "indexed", None, False)], "path string, hash string, size long, mtime long, status string, error string, retried boolean")}

    def merge(batch, _):
        state["m"] = spark.createDataFrame(document.manifest_diff(state["m"], batch).collect())

    results.ingest(spark.readStream.schema("path string, hash string, size long, mtime long").json(str(tmp_path / "in")), merge, str(tmp_path / "mark"))
    assert {r["path"]: r["status"] for r in state["m"].collect()} == {"a": "pending", "b": "missing"}


def test_windows_in_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    results.tumbling(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("hours")) == key(results.tumbling(events))
    assert results.sessions(events).agg(F.sum("n")).first()[0] == events.count()
