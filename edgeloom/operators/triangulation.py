"""Graphs of the Delaunay triangulation, filtered from its sides, alpha shapes and hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kernel as kernel_value
from ..scratch import remove, write
from . import delaunay
from .delaunay import Triangulation
from .graph import Graph

def delaunay_triangles(xy: np.ndarray) -> np.ndarray:
    """Triangles of points in memory; of points at one place the first takes part."""
    places, first = np.unique(xy, axis=0, return_index=True)
    return first[Triangulation(places).triangles()] if len(places) else np.zeros((0, 3), int)


def sides(points: DataFrame) -> DataFrame:
    """p and q (ids, p < q) with px, py, qx, qy of each side of a Delaunay triangle, its opposite corner o, ox, oy, and the
    centre x, y of the triangle's circle: one row for a side on the hull, two for others."""
    t = delaunay.triangles(points)
    bx, by, cx, cy = (F.col(c) - F.col(f"a{c[1]}") for c in ("bx", "by", "cx", "cy"))
    lb, lc = bx * bx + by * by, cx * cx + cy * cy
    twice = 2 * (bx * cy - by * cx)
    t = t.withColumns({"x": F.col("ax") + (cy * lb - by * lc) / twice, "y": F.col("ay") + (bx * lc - cx * lb) / twice})
    end = lambda u, v, o: F.struct(
        *[F.col(c).alias(n) for c, n in ((u, "p"), (v, "q"), (f"{u}x", "px"), (f"{u}y", "py"), (f"{v}x", "qx"), (f"{v}y", "qy"), (o, "o"), (f"{o}x", "ox"), (f"{o}y", "oy"), ("x", "x"), ("y", "y"))]
    )
    each = [F.when(F.col(u) < F.col(v), end(u, v, o)).otherwise(end(v, u, o)) for u, v, o in ("abc", "bca", "cab")]
    return t.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """focal and neighbor with fx, fy, nx, ny, in both directions, of pairs p and q."""
    names = ("focal", "neighbor", "fx", "fy", "nx", "ny")
    ways = [F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]) for cols in (("p", "q", "px", "py", "qx", "qy"), ("q", "p", "qx", "qy", "px", "py"))]
    return pairs.select(F.explode(F.array(*ways)).alias("e")).select("e.*")


_ENDS = ["p", "q", "px", "py", "qx", "qy"]


def delaunay_edges(points: DataFrame, gabriel: bool = False) -> DataFrame:
    """focal, neighbor, their coordinates and squared length of the Delaunay sides, in both directions. gabriel: only those with
    no point inside the circle over the side; if there is one, an opposite corner of the side is inside too."""
    gap = lambda u: (F.col(f"{u}x") - F.col("ox")) * (F.col(f"{u}x") - F.col("ox")) + (F.col(f"{u}y") - F.col("oy")) * (F.col(f"{u}y") - F.col("oy"))
    d2 = lambda a, b: (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")) + (F.col(f"{a}y") - F.col(f"{b}y")) * (F.col(f"{a}y") - F.col(f"{b}y"))
    each = sides(points).groupBy(*_ENDS).agg(F.bool_or(d2("p", "q") > gap("p") + gap("q")).alias("ruled_out"))
    return _both_ways(each.filter(~F.col("ruled_out")) if gabriel else each).withColumn("d2", d2("f", "n"))


def triangulation(
    points: DataFrame, method: str = "delaunay", kernel: str | None = "boxcar", bandwidth: float = math.inf, coplanar: str = "keep", rook: bool = True, clip="bounding_box", seed: int = 0,
) -> Graph:
    """delaunay, gabriel, relative_neighborhood or voronoi (contiguity of clipped cells); weights by a kernel of the edge's
    length. coplanar: keep (of points at one place one takes part, the others are isolates), raise, clique or jitter."""
    from .builders import induce_cliques, jitter, representatives

    if coplanar not in ("keep", "raise", "clique", "jitter"):
        raise ValueError("coplanar must be keep, raise, clique or jitter")
    if coplanar == "jitter":
        points, _ = write(jitter(points, seed))
    elif coplanar != "keep":
        reps = representatives(points)
        if coplanar == "clique":
            return induce_cliques(triangulation(reps.filter("id = rep").select("id", "x", "y"), method, kernel, bandwidth, "keep", rook, clip), reps)
        if not reps.filter("id <> rep").isEmpty():
            raise ValueError("points share a place; use coplanar='clique' or 'jitter'")
    if method == "voronoi":
        from .shapes import voronoi_contiguity

        return voronoi_contiguity(points, rook, clip)

    if method not in ("delaunay", "gabriel", "relative_neighborhood"):
        raise ValueError("method must be delaunay, gabriel, relative_neighborhood or voronoi")
    e, _ = write(delaunay_edges(points, method == "gabriel"))
    if method == "relative_neighborhood":  # a point that rules an edge out lies within its length of both ends
        side = F.sqrt("d2")
        level = F.ceil(F.log2(side)).cast("int")
        one = e.filter("focal < neighbor").withColumns({"level": level, "mx": (F.col("fx") + F.col("nx")) / 2, "my": (F.col("fy") + F.col("ny")) / 2})
        used = one.select("level").distinct()  # powers of two between the shortest and the longest edge
        cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        asked = one.withColumn("cx", around("mx")).withColumn("cy", around("my"))
        at = points.select(F.col("id").alias("k"), F.col("x").cast("double").alias("kx"), F.col("y").cast("double").alias("ky"))
        held = at.crossJoin(F.broadcast(used)).withColumn("cx", cell("kx")).withColumn("cy", cell("ky"))
        gap = lambda n: F.sqrt((F.col(f"{n}x") - F.col("kx")) * (F.col(f"{n}x") - F.col("kx")) + (F.col(f"{n}y") - F.col("ky")) * (F.col(f"{n}y") - F.col("ky")))
        met = asked.join(held, ["level", "cx", "cy"]).filter("k <> focal AND k <> neighbor").withColumns({"ik": gap("f"), "jk": gap("n")})
        bad = met.filter((F.col("ik") > 0) & (F.col("jk") > 0) & (F.col("ik") <= side) & (F.col("jk") <= side)).select("focal", "neighbor").distinct()
        bad = bad.unionByName(bad.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor")))
        e = e.join(bad, ["focal", "neighbor"], "left_anti")
    h = F.lit(float(bandwidth))
    w = F.lit(1.0) if kernel == "boxcar" and bandwidth == math.inf else kernel_value(F.sqrt("d2"), h, kernel or "identity")
    return Graph(e.select("focal", "neighbor", w.alias("weight")), points.select("id"))


def _rim(points: DataFrame, alpha: float) -> DataFrame:
    """u, v with their coordinates: the sides of exactly one triangle with circumradius under 1 / alpha, the triangle to the left."""
    from ..functions.geometry import circumradius

    corner = lambda c: F.struct(F.col(c).alias("id"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"))
    kept = delaunay.triangles(points).filter(circumradius(corner("a"), corner("b"), corner("c")) < 1 / alpha)
    side = kept.select(F.explode(F.array(*[F.struct(corner(p).alias("u"), corner(q).alias("v")) for p, q in ("ab", "bc", "ca")])).alias("s")).select("s.*")
    once = side.groupBy(F.least("u.id", "v.id").alias("p"), F.greatest("u.id", "v.id").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.first("u").alias("u"), F.first("v").alias("v"))
    return once.filter("n = 1").select("u", "v")


def alpha_faces(points: DataFrame, alpha: float) -> DataFrame:
    """Boundary edges (a, b) of the alpha shape: sides of exactly one triangle with circumradius under 1 / alpha."""
    return _rim(points, alpha).select(F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b"))


def _doubled(steps: DataFrame, best, top: int = 64) -> DataFrame:
    """Pointer doubling: ``steps`` (e, to, value) until no value changes. best: of a value and that of the one it points to."""
    spark = steps.sparkSession
    now, path = write(steps)
    for _ in range(top):
        ahead = now.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("value").alias("there"))
        new, new_path = write(now.join(ahead, "to").select("e", F.col("far").alias("to"), best(F.col("value"), F.col("there")).alias("value"), F.col("value").alias("old")))
        remove(spark, path)
        now, path = new.select("e", "to", "value"), new_path
        if new.filter("value <> old").isEmpty():
            break
    return now


def rings_of(rim: DataFrame) -> DataFrame:
    """ring (a number), ring_area (under 0: a hole) and xy (its corners in order) of directed sides u, v with the inside to the left.
    A side goes on to the side that leaves its end first, clockwise from where it came; rings are found by pointer doubling."""
    sides, _ = write(rim.select(F.monotonically_increasing_id().alias("e"), "u", "v"))
    turn = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    out = sides.select(F.col("e").alias("to"), F.col("u.id").alias("at"), turn(F.col("u"), F.col("v")).alias("out"))
    met = sides.select("e", F.col("v.id").alias("at"), turn(F.col("v"), F.col("u")).alias("back")).join(out, "at")
    clockwise = F.pmod(F.col("back") - F.col("out"), F.lit(2 * math.pi))
    steps, _ = write(met.groupBy("e").agg(F.min(F.struct(clockwise.alias("c"), F.col("to"))).alias("m")).select("e", F.col("m.to").alias("to")))
    label = _doubled(steps.withColumn("value", F.least("e", "to")), F.least).select("e", F.col("value").alias("ring"))
    root = F.col("e") == F.col("ring")  # the place in a ring: steps to its root, at which the pointers stop
    ahead = steps.join(label, "e").select("e", F.when(root, F.col("e")).otherwise(F.col("to")).alias("to"), F.when(root, 0).otherwise(1).cast("bigint").alias("value"))
    place = _doubled(ahead, lambda a, b: a + b).select("e", F.col("value").alias("left"))
    flat = sides.join(label, "e").join(place, "e").withColumn("twice", F.col("u.x") * F.col("v.y") - F.col("v.x") * F.col("u.y"))
    xy = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("k"), F.col("u.x").alias("x"), F.col("u.y").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return flat.groupBy("ring").agg((F.sum("twice") / 2).alias("ring_area"), xy.alias("xy"))


def alpha_polygons(points: DataFrame, alpha: float) -> DataFrame:
    """part (from 0), area and parts of the alpha shape's polygons: an outer ring and its holes. A hole belongs to the smallest
    outer ring round it, found by a join of boxes."""
    from ..functions.geometry import contains_point
    from .boxes import box_join, boxed
    from .graph import numbered

    rings, _ = write(rings_of(_rim(points, alpha)))
    outer = rings.filter("ring_area > 0")
    hole = rings.filter("ring_area < 0").select(F.col("ring").alias("hole"), F.col("ring_area").alias("hole_area"), F.col("xy").alias("hole_xy"))
    first, second = F.col("hole_xy")[0], F.col("hole_xy")[1]
    mid = F.struct(((first["x"] + second["x"]) / 2).alias("x"), ((first["y"] + second["y"]) / 2).alias("y"))
    hole = boxed(hole.withColumn("at", mid), F.array("at"), "l_")
    inside = box_join(hole, boxed(outer, F.col("xy"), "r_")).filter(contains_point(F.col("xy"), F.col("at")))
    of = inside.groupBy("hole", "hole_area", "hole_xy").agg(F.min(F.struct("ring_area", "ring")).alias("m")).select(F.col("m.ring").alias("ring"), "hole_area", "hole_xy")
    held = of.groupBy("ring").agg(F.sum("hole_area").alias("less"), F.collect_list("hole_xy").alias("holes"))
    part = numbered(outer.select(F.col("ring").alias("id"))).select(F.col("id").alias("ring"), F.col("ord").alias("part"))
    full = outer.join(held, "ring", "left").join(part, "ring")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return full.select("part", (F.col("ring_area") + F.coalesce("less", F.lit(0.0))).alias("area"), F.concat(F.array("xy"), F.coalesce("holes", none)).alias("parts"))


def bounding_circles(points: DataFrame, alpha: float) -> DataFrame:
    """a, b (ids of an edge of the alpha shape) and the centre (x, y) of the circle of radius 1 / alpha through both, on the
    side without points."""
    place = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    e = alpha_faces(points, alpha).join(place.toDF("a", "ax", "ay"), "a").join(place.toDF("b", "bx", "by"), "b")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = F.sqrt(dx * dx + dy * dy)
    r = F.lit(1 / alpha)
    up = F.sqrt(F.greatest(r * r - d * d / 4, F.lit(0.0)))
    each = e.select("a", "b", "ax", "ay", "bx", "by", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s"), dx.alias("dx"), dy.alias("dy"), d.alias("d"), up.alias("up"))
    each = each.withColumns({"x": (F.col("ax") + F.col("bx")) / 2 - F.col("s") * F.col("up") * F.col("dy") / F.col("d"), "y": (F.col("ay") + F.col("by")) / 2 + F.col("s") * F.col("up") * F.col("dx") / F.col("d")})
    from .joins import band_join

    centres = each.withColumn("id", F.struct("a", "b", "s"))
    held = band_join(centres, place, (1 / alpha) * (1 - 1e-9)).groupBy("focal").agg(F.count(F.lit(1)).alias("n"))
    best = centres.join(held, centres["id"] == held["focal"], "left").groupBy("a", "b").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x", "y")).alias("m"))
    return best.select("a", "b", "m.x", "m.y")


def tightest_radius(xy: np.ndarray, tri: np.ndarray) -> float:
    """Least circumradius bound whose triangles still hold every point and hang together by their sides."""
    a, b, c = (xy[tri[:, k]] for k in range(3))
    la, lb, lc = (np.linalg.norm(p - q, axis=1) for p, q in ((b, c), (a, c), (a, b)))
    twice = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    radius = np.where(twice > 0, la * lb * lc / np.maximum(2 * twice, 1e-300), np.maximum(np.maximum(la, lb), lc) / 2)

    def holds(r: float) -> bool:
        kept = tri[radius <= r]
        if len(np.unique(kept)) < len(np.unique(tri)):
            return False
        root = np.arange(len(kept))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        seen: dict[tuple[int, int], int] = {}
        for k, t in enumerate(kept):
            for p, q in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                other = seen.setdefault((min(p, q), max(p, q)), k)
                root[find(k)] = find(other)
        return len({find(k) for k in range(len(kept))}) == 1

    steps = np.unique(radius)
    low, high = 0, len(steps) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(steps[mid]) else (mid + 1, high)
    return float(steps[low])


def alpha_auto(points: DataFrame, max_points: int = 1_000_000) -> DataFrame:
    """Boundary edges (a, b) of the tightest alpha shape that is one piece and holds all points, with its radius. The radius is
    sought in one task, over the triangles of ``max_points`` points at most."""
    kind = dict(points.dtypes)["id"]
    if points.count() > max_points:
        raise ValueError(f"the tightest radius is sought in one task; {max_points} points at most")
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "id"]).reset_index(drop=True)
        xy = pdf[["x", "y"]].to_numpy(float)
        found = delaunay_triangles(xy)
        return pd.DataFrame({"radius": [tightest_radius(xy, found)] if len(found) else [np.nan]})

    flat = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "id")
    radius = flat.groupBy(F.lit(1).alias("all")).applyInPandas(run, "radius double").first()["radius"]
    return alpha_faces(points, 1 / (radius * (1 + 1e-9))).withColumn("radius", F.lit(radius)).select(F.col("a").cast(kind), F.col("b").cast(kind), "radius")


def convex_hull(points: DataFrame, group: str | None = None) -> DataFrame:
    """Hull vertices (counter-clockwise, ord) of all points or of each group. Only extremes of cells of a partition
    reach the task that joins them: hulls of parts are taken first."""

    def hull(xy: np.ndarray) -> np.ndarray:
        pts = np.unique(xy, axis=0)
        if len(pts) < 3:
            return pts

        def half(ps):
            out: list = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return np.array(half(pts) + half(pts[::-1]))

    key = F.col(group).cast("string") if group else F.lit("all")
    flat = points.select(key.alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def part(batches):
        for pdf in batches:
            for g, rows in pdf.groupby("g", dropna=False):
                h = hull(rows[["x", "y"]].to_numpy())
                yield pd.DataFrame({"g": g, "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"g": pdf["g"].iloc[0], "ord": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return flat.mapInPandas(part, "g string, x double, y double").groupBy("g").applyInPandas(whole, "g string, ord bigint, x double, y double")


def dual(points: DataFrame, margin: float) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """The Voronoi sides, and the points' box grown by ``margin``. A row has the sites p and q with their coordinates, the other
    corners o and w (null at the hull) of the triangles at p and q, the ends ux, uy, vx, vy of the side between the sites' cells (the
    centres of the triangles' circles; at the hull one end lies beyond the box), its length within the box (null if it misses
    the box), and whether it is a point: four sites on one circle, exactly."""
    box = points.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
    low, high = ((box[0] or 0.0) - margin, (box[1] or 0.0) - margin), ((box[2] or 0.0) + margin, (box[3] or 0.0) + margin)
    span = max(high[0] - low[0], high[1] - low[1], 1e-300)
    each = sides(points).groupBy(*_ENDS).agg(F.sort_array(F.collect_list(F.struct("x", "y", "o", "ox", "oy"))).alias("t"))  # two at most
    first, second = F.col("t")[0], F.when(F.size("t") > 1, F.col("t")[1])
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    away = F.when(dx * (first["oy"] - F.col("py")) - dy * (first["ox"] - F.col("px")) > 0, 1.0).otherwise(-1.0)  # the hull's outside
    far = (4 * span + 2 * (F.abs(first["x"]) + F.abs(first["y"]) + max(map(abs, (*low, *high))))) / F.sqrt(dx * dx + dy * dy)
    flat = each.select(
        *_ENDS, first["o"].alias("o"), second["o"].alias("w"), *[first[f"o{c}"].alias(f"o{c}") for c in "xy"], *[second[f"o{c}"].alias(f"w{c}") for c in "xy"],
        first["x"].alias("ux"), first["y"].alias("uy"), F.coalesce(second["x"], first["x"] + away * dy * far).alias("vx"), F.coalesce(second["y"], first["y"] - away * dx * far).alias("vy"),
    )

    def at_one_point(batches):
        for pdf in batches:
            yield pdf.assign(point=on_one_circle(*(pdf[[f"{c}x", f"{c}y"]].to_numpy(float) for c in "pqow")))

    flat = flat.mapInPandas(at_one_point, ", ".join(f"{n} {k}" for n, k in flat.dtypes) + ", point boolean")
    # the part of the side within the box, as shares from 0 (u) to 1 (v)
    ranges = []
    for c, a, b in (("x", low[0], high[0]), ("y", low[1], high[1])):
        u, step = F.col(f"u{c}"), F.col(f"v{c}") - F.col(f"u{c}")
        s, t = (a - u) / F.nullif(step, F.lit(0.0)), (b - u) / F.nullif(step, F.lit(0.0))
        flat_in = u.between(a, b)
        ranges.append((F.when(step != 0, F.least(s, t)).when(flat_in, 0.0).otherwise(2.0), F.when(step != 0, F.greatest(s, t)).when(flat_in, 1.0).otherwise(-1.0)))
    start, end = F.greatest(F.lit(0.0), *[r[0] for r in ranges]), F.least(F.lit(1.0), *[r[1] for r in ranges])
    length = F.when(start <= end + 1e-12, F.greatest(end - start, F.lit(0.0)) * F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")))
    return flat.withColumn("length", length), (*low, *high)


def on_one_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether four points lie on one circle, exactly; false where one is missing. Rows that floats can't decide take fractions."""
    from fractions import Fraction

    (ax, ay), (bx, by), (cx, cy) = ((x - d).T for x in (a, b, c))
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    terms = [la * bx * cy, -la * cx * by, lb * cx * ay, -lb * ax * cy, lc * ax * by, -lc * bx * ay]
    out = np.abs(sum(terms)) <= 1e-14 * sum(np.abs(t) for t in terms)  # wide enough for all that may be
    for k in np.flatnonzero(out).tolist():
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(p) - Fraction(q) for p, q in zip(x[k].tolist(), d[k].tolist(), strict=True)] for x in (a, b, c))
        out[k] = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) == 0
    return out
