"""Join of boxes that meet, by cells of as many sizes as the boxes have.

A box lies at the level of its own size: the least power of two that isn't smaller. At that level it touches four cells at
most, whatever its size. Two boxes that meet share a cell at the level of the larger one, so a box is also dealt, as a guest, to
the cells above it of those levels on which the other side has boxes. Hosts of a level are joined with its guests and hosts;
guests are never joined with each other. One giant box among many small ones costs four rows and a guest row for each
of them, instead of the number of small cells that it covers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVELS = 45  # sizes below the largest one's 2 ** -45 share a level


def boxed(df: DataFrame, points: Column, prefix: str = "") -> DataFrame:
    """``df`` with the box (l, b, r, t) of an array of points; rows without points are left out."""
    ends = (("l", F.array_min, "x"), ("b", F.array_min, "y"), ("r", F.array_max, "x"), ("t", F.array_max, "y"))
    return df.withColumns({f"{prefix}{n}": f(F.transform(points, lambda v: v[c])) for n, f, c in ends}).filter(F.col(f"{prefix}l").isNotNull())


def _level(prefix: str, least: int) -> Column:
    size = F.greatest(F.col(f"{prefix}r") - F.col(f"{prefix}l"), F.col(f"{prefix}t") - F.col(f"{prefix}b"))
    up = F.ceil(F.log2(F.greatest(size, F.lit(5e-324)))).cast("int")
    up = F.when(F.pow(F.lit(2.0), up) < size, up + 1).otherwise(up)  # the logarithm is rounded
    return F.greatest(up, F.lit(least))


def _dealt(df: DataFrame, prefix: str, level: Column) -> DataFrame:
    """One row for each cell of ``level`` that a box touches."""
    df = df.withColumn("_level", level)
    side = F.pow(F.lit(2.0), F.col("_level"))
    cover = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{prefix}{lo}") / side).cast("bigint"), F.floor(F.col(f"{prefix}{hi}") / side).cast("bigint")))
    return df.withColumn("_cx", cover("l", "r")).withColumn("_cy", cover("b", "t"))


def box_join(left: DataFrame, right: DataFrame, l_prefix: str = "l_", r_prefix: str = "r_") -> DataFrame:
    """All columns of both for each pair of rows whose boxes (columns l, b, r, t with the side's prefix) meet, borders
    included, once a pair. Columns of the two must differ in name."""
    at = (l_prefix, r_prefix)
    reach = [F.max(F.greatest(*[F.abs(F.col(f"{x}{c}")) for c in "lbrt"])) for x in at]
    most = max([0.0, *[df.agg(r).first()[0] or 0.0 for df, r in zip((left, right), reach, strict=True)]])
    least = math.frexp(most)[1] - _LEVELS
    own = [df.withColumn("_own", _level(x, least)) for df, x in zip((left, right), at, strict=True)]
    used = [sorted(r[0] for r in df.select("_own").distinct().collect()) for df in own]  # ``_LEVELS`` numbers at most
    hosts = [_dealt(df, x, F.col("_own")) for df, x in zip(own, at, strict=True)]
    guests = []
    for df, x, levels in zip(own, at, used[::-1], strict=True):
        above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v > F.col("_own"))
        guests.append(_dealt(df.withColumn("_up", F.explode(above)), x, F.col("_up")).drop("_up"))
    keys = ["_level", "_cx", "_cy"]
    trim = lambda df: df.drop("_own")
    met = trim(hosts[0]).join(trim(hosts[1]).unionByName(trim(guests[1])), keys).unionByName(trim(guests[0]).join(trim(hosts[1]), keys))
    l, r = ({c: F.col(f"{x}{c}") for c in "lbrt"} for x in at)
    met = met.filter((l["l"] <= r["r"]) & (r["l"] <= l["r"]) & (l["b"] <= r["t"]) & (r["b"] <= l["t"]))
    side = F.pow(F.lit(2.0), F.col("_level"))
    corner = (F.floor(F.greatest(l["l"], r["l"]) / side) == F.col("_cx")) & (F.floor(F.greatest(l["b"], r["b"]) / side) == F.col("_cy"))
    return met.filter(corner).drop(*keys)  # in the cell of the common part's lower left corner only
