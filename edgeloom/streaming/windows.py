"""Extra: lag of windowed sums over a stream of events, along a static graph of users or places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_lag(events: DataFrame, edges: DataFrame, key: str = "user_id", value: str = "value", time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window, id and lag: for each window, the weighted sum of the neighbors' values. Works on a batch or a stream;
    on a stream, state ends with the watermark. Each event is first dealt to the focal nodes that it is a neighbor
    of, so that one aggregation is enough."""
    e = edges.filter("weight <> 0").select(F.col("focal").alias("id"), F.col("neighbor").alias(key), "weight")
    if events.isStreaming:
        events = events.withWatermark(time, late)
    dealt = events.join(e, key)
    return dealt.groupBy(F.window(time, size).alias("w"), "id").agg(F.sum(F.col("weight") * F.col(value)).alias("lag")).select(F.col("w.start").alias("start"), "id", "lag")
