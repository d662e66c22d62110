"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged_at


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of all nodes in ``links`` (a, b: long).

    Every round takes the least label of the neighbours and then the label's own label, so that the rounds grow
    with the logarithm of the longest path. Each round is a table in the shared folder; only a count comes back.
    """
    both, at = staged_at(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now, path = staged_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.lit(True).alias("changed")))
    while not now.filter("changed").isEmpty():
        near = both.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("low"))
        new = now.select("node", F.col("label").alias("old")).join(near, "node").withColumn("label", F.least("old", "low"))
        top = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(top, "label").select("node", F.least("label", "further").alias("label"), "old")
        following, following_path = staged_at(new.select("node", "label", (F.col("label") != F.col("old")).alias("changed")))
        drop_staged(links.sparkSession, path)
        now, path = following, following_path
    drop_staged(links.sparkSession, at)
    return now.select("node", "label")
