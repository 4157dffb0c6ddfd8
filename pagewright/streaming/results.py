"""Streams: results of pages that come in any order, files of a library, and events in windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "doc_id long, page long, kind string, text string"


def settled(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, page, text, status): one row for each expected page. Progress settles nothing, of several answers the first by text counts, an error or no answer leaves a blank page."""
    final = results.where(F.col("kind").isin("done", "error")).groupBy("doc_id", "page").agg(F.max_by(F.struct("kind", "text"), F.struct(F.col("kind") == "done", F.coalesce("text", F.lit("")))).alias("r"))
    status = F.when(F.col("r.kind") == "done", "done").when(F.col("r.kind") == "error", "failed").otherwise("missing")
    return expected.join(final, ["doc_id", "page"], "left").select("doc_id", "page", F.when(status == "done", F.col("r.text")).otherwise("").alias("text"), status.alias("status"))


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's JSON lines of results as a stream."""
    return spark.readStream.schema(RESULT).json(folder)


def collect_pages(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends each page's first answer to a table; a restart goes on from the checkpoint."""
    answers = stream.where(F.col("kind").isin("done", "error")).withColumn("at", F.current_timestamp()).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["doc_id", "page"]).drop("at")
    answers.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each batch of files seen to a merge of the manifest; the checkpoint makes it resumable."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on its time, which must then be one with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events, streamed or not."""
    kept = _timed(events, "10 minutes")
    return kept.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): a user's events with no pause as long as the gap."""
    kept = _timed(events, "10 minutes")
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's earliest event; in a stream each key's first one within the watermark."""
    if events.isStreaming:
        return _timed(events, "1 hour").dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min(F.struct("ts", "event_id")).alias("e")).select(*keys, "e.*")
