"""Spatial joins as equi-joins of grid cells: no pair outside neighboring cells is ever made."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sphere
from ..scratch import remove, write


def minkowski(p: float, a: tuple, b: tuple) -> Column:
    gaps = [F.abs(u - v) for u, v in zip(a, b, strict=True)]
    if p == 2 and len(gaps) == 2:
        return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1])
    if p == math.inf:
        return F.greatest(*gaps)
    if p == 1:
        return sum(gaps[1:], gaps[0])
    return F.pow(sum((F.pow(g, F.lit(p)) for g in gaps), F.lit(0.0)), F.lit(1 / p))


def band_join(left: DataFrame, right: DataFrame, radius: float, coords: tuple[str, ...] = ("x", "y"), p: float = 2) -> DataFrame:
    """focal (ids of ``left``), neighbor (ids of ``right``) and distance of all pairs within ``radius``, inclusive.

    Cells have the side of the radius, so a pair lies in the same or in touching cells: each left point is joined to
    3^d cells by an equi-join, and only the exact distance is left to filter. Dense cells are skewed keys, which
    adaptive execution splits."""
    side = max(float(radius), 1e-12)
    cell = lambda c: F.floor(F.col(c) / side)
    near = left.select(F.col("id").alias("focal"), *[F.col(c).alias(f"a_{c}") for c in coords], *[cell(c).alias(f"k_{c}") for c in coords])
    for c in coords:
        near = near.withColumn(f"k_{c}", F.explode(F.sequence(F.col(f"k_{c}") - 1, F.col(f"k_{c}") + 1)))
    far = right.select(F.col("id").alias("neighbor"), *[F.col(c).alias(f"b_{c}") for c in coords], *[cell(c).alias(f"k_{c}") for c in coords])
    d = minkowski(p, tuple(F.col(f"a_{c}") for c in coords), tuple(F.col(f"b_{c}") for c in coords))
    return near.join(far, [f"k_{c}" for c in coords]).select("focal", "neighbor", d.alias("distance")).filter(F.col("distance") <= radius)


def sphere_band_join(left: DataFrame, right: DataFrame, arc: float, radius: float = sphere.RADIUS_EARTH_KM) -> DataFrame:
    """As band_join for points with lon and lat and great-circle distances, by cells of the unit sphere's chords."""
    chord = math.sqrt(max(0.0, 2 - 2 * math.cos(min(arc / radius, math.pi)))) + 1e-9
    on = lambda df: df.select("id", sphere.to_xyz(F.col("lon"), F.col("lat")).alias("s")).select("id", "s.*")
    pairs = band_join(on(left), on(right), chord, ("x", "y", "z"))
    return pairs.withColumn("distance", sphere.linear_to_arc(F.col("distance"), radius)).filter(F.col("distance") <= arc + 1e-9)


def nearest_join(
    left: DataFrame, right: DataFrame, k: int, coords: tuple[str, ...] = ("x", "y"), p: float = 2, others: bool = False, levels: int = 24, deepest: int = 50,
    measured: tuple[str, ...] = (), measure: Callable[[tuple, tuple], Column] | None = None, grain: float = 0.0,
) -> DataFrame:
    """focal (ids of ``left``), neighbor (ids of ``right``) and distance of the k nearest right points of each left one;
    ties go to the lesser id. others: a point isn't its own neighbor (for a set joined with itself). measure: the distance by the
    columns ``measured``, which orders points as ``coords`` do but for rounding; no cell is narrower than ``grain``, which is far over it.

    Cells halve their sides from level to level, over the extent of both sets. The right points of every cell of every
    level are counted by one partial aggregate. A left point takes the finest cell that holds enough right points, so its
    neighbors are within that cell's diagonal, and is joined once to the cells of that size around it: dense and sparse
    regions have cells of their own size. Where a cell of the finest level still holds many points (as one far point widens the extent
    of all), its points have further levels, down to what a float can tell apart. Of points at one place only
    as many as can be neighbors, those with the least ids, are candidates; so a place with a large share of all points
    makes no quadratic join. The cut to k happens before the shuffle of the ranking.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    need = k + int(others)
    flat = lambda df: df.select("id", *[F.col(c).cast("double").alias(c) for c in (*coords, *measured)])
    near, far = flat(left), flat(right)
    box = near.unionByName(far).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in coords for f in (F.min, F.max)]).first()
    if any(box[f"min_{c}"] is None for c in coords):
        return near.join(far.select(F.col("id").alias("neighbor")), F.lit(False)).select(F.col("id").alias("focal"), "neighbor", F.lit(0.0).alias("distance"))
    side = max(max(box[f"max_{c}"] - box[f"min_{c}"] for c in coords), 1e-12) * (1 + 1e-9)
    if grain:
        levels, deepest = (min(n, max(0, int(math.log2(side / grain)))) for n in (levels, deepest))
    size = lambda level: F.lit(side) / F.pow(F.lit(2.0), level)
    at = lambda level: [F.floor((F.col(c) - box[f"min_{c}"]) / size(level)).cast("bigint").alias(f"k_{c}") for c in coords]
    keys = ["level", *[f"k_{c}" for c in coords]]
    far = far.withColumn("place", F.row_number().over(W.partitionBy(*(measured or coords)).orderBy("id"))).filter(F.col("place") <= need).drop("place")
    ends = [F.lit(levels)] * 2
    crowded = far.groupBy(*at(F.lit(levels))).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 16 * need).drop("n")
    crowded, path = write(crowded)
    if not crowded.isEmpty():
        deep = F.when(F.col("_deep"), F.lit(deepest)).otherwise(F.lit(levels))
        marked = crowded.withColumn("_deep", F.lit(True))
        names = [f"k_{c}" for c in coords]
        near, far = (df.select("*", *at(F.lit(levels))).join(marked, names, "left").drop(*names) for df in (near, far))
        ends = [deep, deep]
    else:
        remove(left.sparkSession, path)
    all_levels = lambda end: F.explode(F.sequence(F.lit(0), end)).alias("level")
    full = far.select(*coords, all_levels(ends[1])).select("level", *at(F.col("level"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).drop("n")
    finest = near.select("id", *coords, all_levels(ends[0])).select("id", "level", *at(F.col("level"))).join(full, keys, "left_semi").groupBy("id").agg(F.max("level").alias("own"))
    up = math.ceil(math.log2(len(coords) ** (0 if p == math.inf else 1 / p)) - 1e-9)  # the diagonal's level
    asked = near.join(finest, "id", "left").withColumn("level", F.greatest(F.coalesce("own", F.lit(0)) - up, F.lit(0)))
    asked = asked.select(F.col("id").alias("focal"), "level", *[F.col(c).alias(f"a_{c}") for c in (*coords, *measured)], *at(F.col("level")))
    used = asked.select("level").distinct()  # ``levels`` + 1 rows at most
    for c in coords:
        asked = asked.withColumn(f"k_{c}", F.explode(F.sequence(F.col(f"k_{c}") - 1, F.col(f"k_{c}") + 1)))
    held = far.crossJoin(F.broadcast(used)).select("level", F.col("id").alias("neighbor"), *[F.col(c).alias(f"b_{c}") for c in (*coords, *measured)], *at(F.col("level")))
    a, b = (tuple(F.col(f"{end}_{c}") for c in measured or coords) for end in "ab")
    d = measure(a, b) if measure else minkowski(p, a, b)
    pairs = asked.join(held, keys).select("focal", "neighbor", d.alias("distance"))
    if others:
        pairs = pairs.filter("focal <> neighbor")
    rank = F.row_number().over(W.partitionBy("focal").orderBy("distance", "neighbor"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def knn_join(points: DataFrame, k: int, coords: tuple[str, ...] = ("x", "y"), p: float = 2) -> DataFrame:
    """focal, neighbor, distance of the k nearest other points of each."""
    return nearest_join(points, points, k, coords, p, others=True)


def _on_sphere(points: DataFrame) -> DataFrame:
    return points.select("id", sphere.to_xyz(F.col("lon"), F.col("lat")).alias("s")).select("id", "s.*")


def sphere_knn_join(points: DataFrame, k: int, radius: float = sphere.RADIUS_EARTH_KM) -> DataFrame:
    """As knn_join for points with lon and lat. Chords, which order points as great circles do, find the candidates; great circles
    rank them, since chords of near points have lost their last digits."""
    p = points.select("id", "lon", "lat", sphere.to_xyz(F.col("lon"), F.col("lat")).alias("s")).select("id", "lon", "lat", "s.*")
    arc = lambda a, b: sphere.harcdist(*a, *b, radius)
    return nearest_join(p, p, k, ("x", "y", "z"), others=True, measured=("lon", "lat"), measure=arc, grain=1e-14)


def sphere_nearest_join(left: DataFrame, right: DataFrame, k: int, radius: float = sphere.RADIUS_EARTH_KM) -> DataFrame:
    """As nearest_join for points with lon and lat."""
    near = nearest_join(_on_sphere(left), _on_sphere(right), k, ("x", "y", "z"))
    return near.withColumn("distance", sphere.linear_to_arc(F.col("distance"), radius))


def segment_nearest_join(points: DataFrame, segments: DataFrame, radius: float | None = None) -> DataFrame:
    """id, segment_id, distance of the nearest segment (id, p, q: structs of x and y) of each point; ties go to the lesser id.

    Segments lie in the cells of their boxes. The search begins with the cells around a point and goes on, for points
    that found none near enough, with cells of twice the side; rounds end when all points are done or one cell spans all.
    """
    from ..functions import geometry as geo

    box = segments.select("id", "p", "q", *[f(F.col("p")[c], F.col("q")[c]).alias(n) for n, f, c in (("l", F.least, "x"), ("b", F.least, "y"), ("r", F.greatest, "x"), ("t", F.greatest, "y"))])
    size = box.agg(F.avg(F.greatest(F.col("r") - F.col("l"), F.col("t") - F.col("b"))).alias("mean"), F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("t").alias("t")).first()
    if not size["n"]:
        return points.select("id").join(segments.select(F.col("id").alias("segment_id"), F.lit(0.0).alias("distance")), F.lit(False))
    span = max(size["r"] - size["l"], size["t"] - size["b"], 1e-9)
    side = radius or max(size["mean"], span / max(size["n"], 1) ** 0.5, 1e-9)
    reach = points.agg(F.max(F.greatest(F.abs(F.col("x") - size["l"]), F.abs(F.col("x") - size["r"]), F.abs(F.col("y") - size["b"]), F.abs(F.col("y") - size["t"])))).first()[0] or 0.0
    todo, found, path = points.select("id", "x", "y"), None, None
    while True:
        cover = lambda lo, hi, s=side: F.explode(F.sequence(F.floor(F.col(lo) / s), F.floor(F.col(hi) / s)))
        held = box.withColumn("cx", cover("l", "r")).withColumn("cy", cover("b", "t")).select("cx", "cy", F.col("id").alias("segment_id"), "p", "q")
        asked = todo
        for c, k in (("x", "cx"), ("y", "cy")):
            asked = asked.withColumn(k, F.explode(F.sequence(F.floor(F.col(c) / side) - 1, F.floor(F.col(c) / side) + 1)))
        gap = geo.segment_point_dist(F.col("p"), F.col("q"), F.struct("x", "y"))["dist"]
        best = asked.join(held, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(gap.alias("distance"), F.col("segment_id"))).alias("m"))
        top, _ = write(best.select("id", "m.segment_id", "m.distance"))
        done = top if side > 2 * (span + reach) else top.filter(F.col("distance") <= side)
        found = done if found is None else found.unionByName(done)
        rest = todo.join(done.select("id"), "id", "left_anti")
        if side > 2 * (span + reach) or rest.isEmpty():
            return found.select("id", "segment_id", "distance")
        rest, rest_path = write(rest)
        if path:
            remove(points.sparkSession, path)
        todo, path = rest, rest_path
        side *= 2
