"""Joins of polygons: points inside, boundaries that touch, Voronoi cells, clipping by convex rings.

polygons: id, parts (array of rings, each array<struct<x,y>> without a closing point)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .boxes import box_join, boxed
from .graph import Graph
from .triangulation import dual

RING = "array<struct<x:double,y:double>>"


def points_in_polygons(points: DataFrame, polygons: DataFrame, how: str = "inner") -> DataFrame:
    """id (of the point) and polygon_id of all points in or on a polygon's rings. how: inner or left.

    Points are boxes without an extent, joined to the polygons' boxes at the level of each polygon's own size."""
    at = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = boxed(points.select("id", at.alias("at")), F.array("at"), "l_").filter("l_l IS NOT NULL AND l_b IS NOT NULL")
    q = boxed(polygons.select(F.col("id").alias("polygon_id"), "parts"), F.flatten("parts"), "r_")
    hit = box_join(p, q).filter(F.exists("parts", lambda r: geo.contains_point(r, F.col("at")))).select("id", "polygon_id")
    return hit if how == "inner" else points.select("id").join(hit, "id", "left")


def strict_contiguity(polygons: DataFrame, rook: bool = True, by_perimeter: bool = False) -> Graph:
    """Polygons whose boundaries touch although they share no vertex: sides that overlap along a length (rook), or
    meet in any point (queen). Interiors are taken to be disjoint, as in a partition of the plane."""
    ring = polygons.select("id", F.explode("parts").alias("r"))
    sides = ring.select("id", F.explode(F.zip_with("r", geo.closed(F.col("r")), lambda a, b: F.struct(a.alias("p"), b.alias("q")))).alias("s")).select("id", "s.p", "s.q").filter("p <> q")
    a, b = (boxed(sides.select(*[F.col(c).alias(f"{n}{c}") for c in ("id", "p", "q")]), F.array(f"{n}p", f"{n}q"), n) for n in "uv")
    meet = box_join(a, b, "u", "v").filter("uid <> vid")
    up, uq, vp, vq = (F.col(c) for c in ("up", "uq", "vp", "vq"))
    length = geo.points_dist(up, uq)
    along = lambda p: ((p["x"] - up["x"]) * (uq["x"] - up["x"]) + (p["y"] - up["y"]) * (uq["y"] - up["y"])) / length
    off = lambda p: F.abs(geo.orientation(up, uq, p)) / length
    common = F.least(length, F.greatest(along(vp), along(vq))) - F.greatest(F.lit(0.0), F.least(along(vp), along(vq)))
    overlap = F.when((off(vp) <= 1e-9) & (off(vq) <= 1e-9) & (common > 1e-9), common).otherwise(0.0)
    near = F.least(*[geo.segment_point_dist(x, y, z)["dist"] for x, y, z in ((up, uq, vp), (up, uq, vq), (vp, vq, up), (vp, vq, uq))]) <= 1e-9
    touch = meet.withColumns({"overlap": overlap, "near": near | geo.seg_intersect(up, uq, vp, vq)})
    pairs = touch.groupBy(F.col("uid").alias("focal"), F.col("vid").alias("neighbor")).agg(F.sum("overlap").alias("overlap"), F.max("near").alias("near"))
    pairs = pairs.filter("overlap > 0") if rook or by_perimeter else pairs.filter("near OR overlap > 0")
    return Graph(pairs.select("focal", "neighbor", (F.col("overlap") if by_perimeter else F.lit(1.0)).alias("weight")), polygons.select("id"))


def _cut(ring: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The part of a convex ring where ``inside`` (a signed value of each vertex) isn't negative."""
    out = []
    for k in range(len(ring)):
        j = (k + 1) % len(ring)
        if inside[k] >= 0:
            out.append(ring[k])
        if (inside[k] > 0 > inside[j]) or (inside[k] < 0 < inside[j]):
            out.append(ring[k] + inside[k] / (inside[k] - inside[j]) * (ring[j] - ring[k]))
    return np.array(out).reshape(-1, 2)


def _as_ring(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def voronoi_cells(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """id and parts: each point's cell within the points' bounding box, grown by ``margin``. A cell's corners are the centres
    of the circles of the point's triangles, in their order round it; cells at the box are the box cut by the half planes
    towards the neighbors."""
    sides, (l, b, r, t) = dual(points, margin)
    frame = np.array([[l, b], [r, b], [r, t], [l, t]], float)

    @F.pandas_udf(f"array<{RING}>")
    def cut(own: pd.DataFrame, others: pd.Series) -> pd.Series:
        out = []
        for x, y, near in zip(own["x"], own["y"], others, strict=True):
            ring = frame
            for n in near:
                d = np.array([n["x"] - x, n["y"] - y])
                mid = np.array([n["x"] + x, n["y"] + y]) / 2
                if len(ring):
                    ring = _cut(ring, -((ring - mid) @ d))
            out.append([_as_ring(ring)])
        return pd.Series(out)

    ends = [F.col(c) for c in ("ux", "uy", "vx", "vy", "w")]
    one = lambda p, q: F.struct(F.col(p).alias("id"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"), F.col(f"{q}x").alias("nx"), F.col(f"{q}y").alias("ny"), *ends)
    each = sides.select(F.explode(F.array(one("p", "q"), one("q", "p"))).alias("e")).select("e.*")
    corner = lambda u: F.struct(F.atan2(F.col(f"{u}y") - F.col("y"), F.col(f"{u}x") - F.col("x")).alias("turn"), F.col(f"{u}x").alias("x"), F.col(f"{u}y").alias("y"))
    within = F.col("w").isNotNull()
    for u in "uv":
        within &= F.col(f"{u}x").between(l, r) & F.col(f"{u}y").between(b, t)
    cells = each.groupBy("id", "x", "y").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array(corner("u"), corner("v")))))).alias("ring"),
        F.sort_array(F.collect_list(F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")))).alias("near"), F.bool_and(within).alias("whole"),
    )
    ring = F.array(F.transform("ring", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))))
    inner = cells.filter("whole").select("id", ring.alias("parts"))
    return inner.unionByName(cells.filter("NOT whole").select("id", cut(F.struct("x", "y"), "near").alias("parts")))


def intersect_convex(ring, clipper):
    """Column: the part of a convex ring inside another convex, counter-clockwise ring; empty where they don't meet."""

    @F.pandas_udf(RING)
    def clip(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for ra, rb in zip(a, b, strict=True):
            if ra is None or rb is None:
                out.append(None)
                continue
            ring, c = np.array([[p["x"], p["y"]] for p in ra]), np.array([[p["x"], p["y"]] for p in rb])
            for k in range(len(c)):
                if len(ring):
                    d = c[(k + 1) % len(c)] - c[k]
                    ring = _cut(ring, d[0] * (ring[:, 1] - c[k, 1]) - d[1] * (ring[:, 0] - c[k, 0]))
            out.append(_as_ring(ring))
        return pd.Series(out)

    return clip(ring, clipper)


def dissolve_sides(polygons: DataFrame, by: str) -> DataFrame:
    """Outer boundary of each group of polygons that meet along whole sides: the sides (a, b) of exactly one of them."""
    ring = polygons.select(F.col(by).alias("group"), F.explode("parts").alias("r"))
    s = ring.select("group", F.explode(F.zip_with("r", geo.closed(F.col("r")), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s")).select("group", "s.*")
    return s.groupBy("group", "a", "b").count().filter("count = 1").drop("count")
