"""Connected components of a table of links, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for the ids of links (a, b): comp is the least id of the component.

    Each round an id takes the least label among its own and its neighbours', then the label of its label; a
    label's round ends in a table. A hub's labels are combined before they are dealt out.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = written(lower, "lower")
        jump = lower.join(lower.select(F.col("id").alias("to"), F.col("comp").alias("far")), F.col("comp") == F.col("to"))
        new = written(jump.select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        moved = new.where("old != comp").limit(1).count()
        drop(lower)
        drop(labels)
        labels = new.drop("old")
        if not moved:
            drop(both)
            return labels
