"""Iterative graph algorithms as rounds of joins, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, write


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id), by weight != 0 edges in either direction. Labels halve their paths each
    round, so the rounds grow with the logarithm of the longest path."""
    spark = nodes.sparkSession
    links = edges.filter("weight <> 0 AND focal <> neighbor")
    both, both_path = write(links.select(F.col("focal").alias("a"), F.col("neighbor").alias("b")).unionByName(links.select(F.col("neighbor").alias("a"), F.col("focal").alias("b"))).distinct())
    now, path = write(nodes.select("id").join(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")), "id", "left").select("id", F.least("id", "low").alias("component"), F.col("low").isNotNull().alias("changed")))
    while not now.filter("changed").isEmpty():
        low = both.join(now.select(F.col("id").alias("a"), "component"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("low"))
        new = now.select("id", F.col("component").alias("old")).join(low, "id", "left").withColumn("component", F.least("old", "low"))
        top = now.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = new.join(top, "component").select("id", F.least("component", "further").alias("component"), "old")
        following, following_path = write(new.select("id", "component", (F.col("component") != F.col("old")).alias("changed")))
        remove(spark, path)
        now, path = following, following_path
    remove(spark, both_path)
    return now.select("id", "component")


def hops(nodes: DataFrame, edges: DataFrame, kmax: int | None = None) -> DataFrame:
    """focal, neighbor, hops: least number of steps between different nodes that reach each other, up to ``kmax``
    (None: until nothing new is reached)."""
    links, links_path = write(edges.filter("weight <> 0 AND focal <> neighbor").select("focal", "neighbor").distinct())
    front, _ = write(links.withColumn("hops", F.lit(1).cast("bigint")))
    seen, k = front, 1
    while (kmax is None or k < kmax) and not front.isEmpty():
        k += 1
        step = front.select("focal", F.col("neighbor").alias("via")).join(links.select(F.col("focal").alias("via"), "neighbor"), "via").filter("focal <> neighbor").select("focal", "neighbor").distinct()
        front, _ = write(step.join(seen.select("focal", "neighbor"), ["focal", "neighbor"], "left_anti").withColumn("hops", F.lit(k).cast("bigint")))
        seen = seen.unionByName(front)
    remove(nodes.sparkSession, links_path)
    return seen


def travel_costs(edges: DataFrame, origins: DataFrame, threshold: float) -> DataFrame:
    """origin, node, cost: cheapest paths of at most ``threshold`` over edges (u, v, cost), by rounds of relaxation."""
    both = edges.select("u", "v", "cost").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")).groupBy("u", "v").agg(F.min("cost").alias("cost"))
    both, both_path = write(both)
    best, path = write(origins.select(F.col("node").alias("origin"), "node").distinct().withColumn("cost", F.lit(0.0)).withColumn("fresh", F.lit(True)))
    while not best.filter("fresh").isEmpty():
        step = best.filter("fresh").select("origin", F.col("node").alias("u"), F.col("cost").alias("so_far")).join(both, "u").select("origin", F.col("v").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost")).filter(F.col("cost") <= threshold)
        both_costs = best.select("origin", "node", "cost", F.col("cost").alias("old")).unionByName(step.withColumn("old", F.lit(None).cast("double")))
        new = both_costs.groupBy("origin", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old")).select("origin", "node", "cost", (F.col("old").isNull() | (F.col("cost") < F.col("old"))).alias("fresh"))
        following, following_path = write(new)
        remove(edges.sparkSession, path)
        best, path = following, following_path
    remove(edges.sparkSession, both_path)
    return best.select("origin", "node", "cost")
