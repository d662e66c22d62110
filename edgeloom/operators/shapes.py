"""Relations, overlay and merging of polygons (id, parts) over tables: candidates by cells of boxes, then exact regions.

Rings may be holes: a place is inside a polygon if it lies in an odd number of its rings.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions
from ..scratch import write
from .graph import Graph
from .boxes import box_join, boxed
from .polygons import RING, voronoi_cells

PARTS = f"array<{RING}>"
PREDICATES = ("intersects", "contains", "within", "touches", "overlaps", "equals", "disjoint", "crosses")


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_KINDS = {PARTS: pa.list_(_POINTS), "double": pa.float64(), "boolean": pa.bool_()}


def _rings(column: pa.Array) -> list:
    """The rings of each polygon of a column, as arrays; None for a null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lines = column.flatten()
    at = lines.flatten()
    xy = np.stack([at.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], 1) if len(at) else np.zeros((0, 2))
    cut = lambda x: np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    ring, shape = cut(lines), cut(column)
    held = [xy[p:q] for p, q in zip(ring, ring[1:])]
    return [[r for r in held[p:q] if len(r) > 2] if ok else None for p, q, ok in zip(shape, shape[1:], column.is_valid().to_pylist())]


def _arrow(f, kind: str, *columns: Column) -> Column:
    """An Arrow function of one or two columns."""
    if len(columns) == 1:

        def run(a: pa.Array) -> pa.Array:
            return f(a)

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    else:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return f(a, b)

        run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(*columns)


def _column(f, kind: str, *columns: Column) -> Column:
    """A function of polygons, given as lists of rings; null where one of them is."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([None if any(v is None for v in row) else f(*row) for row in zip(*map(_rings, arrays), strict=True)], _KINDS[kind])

    return _arrow(run, kind, *columns)


def as_parts(shapes: DataFrame) -> DataFrame:
    """id and parts; points (x, y) and boxes (left, lower, right, upper) become rings."""
    if "parts" in shapes.columns:
        return shapes.select("id", "parts")
    if "left" in shapes.columns:
        corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        return shapes.select("id", F.array(F.array(corner("left", "lower"), corner("right", "lower"), corner("right", "upper"), corner("left", "upper"))).alias("parts"))
    raise ValueError("shapes need the column parts, or left, lower, right and upper")


def validate(shapes: DataFrame, kinds: tuple[str, ...] = ("point", "polygon")) -> str:
    """The kind of a table of shapes: point (x, y), lonlat (lon, lat) or polygon (parts); an error for other columns or
    kinds, repeated or null ids, null coordinates."""
    held = set(shapes.columns)
    kind = "polygon" if "parts" in held else "point" if {"x", "y"} <= held else "lonlat" if {"lon", "lat"} <= held else None
    if "id" not in held or kind is None or kind not in kinds:
        raise ValueError(f"shapes need an id and the columns of {' or '.join(kinds)}")
    part = {"polygon": ["parts"], "point": ["x", "y"], "lonlat": ["lon", "lat"]}[kind]
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ["id", *part]])
    if not shapes.filter(null).isEmpty():
        raise ValueError("ids and coordinates mustn't be null")
    if not shapes.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("ids are repeated")
    return kind


def candidates(left: DataFrame, right: DataFrame, grow: float = 0.0) -> DataFrame:
    """l_id, l_parts, r_id, r_parts of the pairs whose boxes, the left one grown, meet."""
    a, b = (boxed(as_parts(df).select(F.col("id").alias(f"{n}_id"), F.col("parts").alias(f"{n}_parts")), F.flatten(f"{n}_parts"), f"{n}_") for df, n in ((left, "l"), (right, "r")))
    a = a.withColumns({f"l_{c}": F.col(f"l_{c}") - grow for c in "lb"} | {f"l_{c}": F.col(f"l_{c}") + grow for c in "rt"})
    return box_join(a, b).select("l_id", "l_parts", "r_id", "r_parts")


def relation(a: Column, b: Column, predicate: str) -> Column:
    """Whether two polygons stand in a relation: one of ``PREDICATES``."""
    if predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {', '.join(PREDICATES)}")
    return _column(lambda x, y: bool(regions.relations(x, y)[predicate]), "boolean", a, b)


def polygon_distance(a: Column, b: Column) -> Column:
    return _column(regions.distance, "double", a, b)


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner", predicate: str = "intersects") -> DataFrame:
    """left_id and right_id of the polygons of two tables that stand in a relation. how: inner, or left or right with
    nulls for those without a partner."""
    if predicate == "disjoint":
        raise ValueError("disjoint pairs have no index; use relation()")
    hit = candidates(left, right).filter(relation(F.col("l_parts"), F.col("r_parts"), predicate)).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))
    if how == "inner":
        return hit
    if how == "left":
        return left.select(F.col("id").alias("left_id")).join(hit, "left_id", "left")
    if how == "right":
        return right.select(F.col("id").alias("right_id")).join(hit, "right_id", "left").select("left_id", "right_id")
    raise ValueError("how must be inner, left or right")


def overlay(left: DataFrame, right: DataFrame, how: str = "intersection") -> DataFrame:
    """left_id, right_id and parts of the pieces of two layers: intersection, difference, identity, union or
    symmetric_difference. Polygons of one layer are taken not to overlap each other."""
    if how not in ("intersection", "difference", "identity", "union", "symmetric_difference"):
        raise ValueError("how must be intersection, difference, identity, union or symmetric_difference")
    pairs = candidates(left, right)
    both = _column(lambda x, y: regions.parts_of(regions.overlay(x, y, "intersection")), PARTS, F.col("l_parts"), F.col("r_parts"))
    common = pairs.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), both.alias("parts")).filter(F.size("parts") > 0)

    def rest(mine: DataFrame, own: str, theirs: str) -> DataFrame:
        near = pairs.groupBy(F.col(f"{own}_id").alias("id")).agg(F.collect_list(f"{theirs}_parts").alias("others"))

        def without(parts: pa.Array, others: pa.Array) -> pa.Array:
            flat, ends = _rings(others.flatten()), np.concatenate([[0], np.cumsum(others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            left = [reduce(lambda x, o: regions.overlay(x, o, "difference") if x else x, flat[p:q], shape) for shape, p, q in zip(_rings(parts), ends, ends[1:])]
            return pa.array([regions.parts_of(x) for x in left], _KINDS[PARTS])

        out = as_parts(mine).join(near, "id", "left").select("id", _arrow(without, PARTS, F.col("parts"), F.col("others")).alias("parts")).filter(F.size("parts") > 0)
        ids = {"l": ("id", None), "r": (None, "id")}[own]
        kinds = (dict(left.dtypes)["id"], dict(right.dtypes)["id"])
        return out.select(*[(F.col(c) if c else F.lit(None).cast(kind)).alias(n) for n, c, kind in zip(("left_id", "right_id"), ids, kinds, strict=True)], "parts")

    out = {"intersection": [common], "difference": [rest(left, "l", "r")], "identity": [common, rest(left, "l", "r")], "union": [common, rest(left, "l", "r"), rest(right, "r", "l")], "symmetric_difference": [rest(left, "l", "r"), rest(right, "r", "l")]}[how]
    return reduce(DataFrame.unionByName, out)


def _folded(rows: DataFrame, keys: list[str], how: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(group: pa.Table) -> pa.Table:
        shapes = _rings(group.column("parts"))
        got = reduce(lambda x, y: regions.overlay(x, y, how), shapes[1:], shapes[0])
        return pa.table([*(group.column(k).slice(0, 1) for k in keys), pa.array([regions.parts_of(got)], _KINDS[PARTS])], [*keys, "parts"])

    return rows.groupBy(*keys).applyInArrow(run, f"{', '.join(f'`{k}` {kinds[k]}' for k in keys)}, parts {PARTS}")


def union(polygons: DataFrame, by: str | None = None, rounds: int = 3) -> DataFrame:
    """group and parts: the union of the polygons of each group (of all, without ``by``).

    Neighbors are merged first: polygons of a group meet by the grid cell of their box's corner, then by cells eight
    times as wide, and at last the group's outlines. Inner sides vanish on the way, so no task holds a group's polygons."""
    rows = polygons.select((F.col(by) if by else F.lit(0)).alias("group"), "parts")
    box = boxed(polygons, F.flatten("parts"))
    side = 4 * max(float(box.agg(F.avg(F.greatest(F.col("r") - F.col("l"), F.col("t") - F.col("b")))).first()[0] or 1.0), 1e-9)
    for _ in range(rounds):
        at = boxed(rows, F.flatten("parts"))
        rows = _folded(at.select("group", F.floor(F.col("l") / side).alias("cx"), F.floor(F.col("b") / side).alias("cy"), "parts"), ["group", "cx", "cy"], "union").select("group", "parts")
        side *= 8
    return _folded(rows.select("group", "parts"), ["group"], "union").filter(F.size("parts") > 0)


dissolve = union


def intersection(polygons: DataFrame, by: str | None = None, tasks: int = 32) -> DataFrame:
    """group and parts: what all polygons of each group have in common (no rings: nothing). Folded in parts, then over them."""
    rows = polygons.select((F.col(by) if by else F.lit(0)).alias("group"), F.pmod(F.xxhash64("parts"), F.lit(tasks)).alias("part"), "parts")
    return _folded(_folded(rows, ["group", "part"], "intersection").select("group", "parts"), ["group"], "intersection")


def fuzzy_contiguity(polygons: DataFrame, buffer: float = 0.0, tolerance: float | None = None, predicate: str | None = "intersects") -> Graph:
    """Polygons that meet when each is grown by ``buffer`` (or tolerance * 0.5 * the lesser extent of all), which is when
    they are within twice that of each other. Other predicates hold for polygons grown with round corners of 64 sides;
    None: boxes that meet."""
    flat = boxed(as_parts(polygons), F.flatten("parts"))
    if tolerance is not None:
        if buffer:
            raise ValueError("give buffer or tolerance, not both")
        size = flat.agg((F.max("r") - F.min("l")).alias("w"), (F.max("t") - F.min("b")).alias("h")).first()
        buffer = tolerance * 0.5 * min(size["w"] or 0, size["h"] or 0)
    pairs = candidates(polygons, polygons, 2 * buffer).filter("l_id <> r_id")
    if predicate == "intersects":
        pairs = pairs.filter(polygon_distance(F.col("l_parts"), F.col("r_parts")) <= 2 * buffer + 1e-12)
    elif predicate is not None:
        if buffer > 0:
            grown = as_parts(polygons).select("id", buffered(F.col("parts"), buffer).alias("parts"))
            pairs = candidates(grown, grown).filter("l_id <> r_id")
        pairs = pairs.filter(relation(F.col("l_parts"), F.col("r_parts"), predicate))
    return Graph(pairs.select(F.col("l_id").alias("focal"), F.col("r_id").alias("neighbor"), F.lit(1.0).alias("weight")), polygons.select("id"))


def nonplanar_neighbors(graph: Graph, polygons: DataFrame, tolerance: float = 0.001) -> tuple[Graph, DataFrame]:
    """The graph with links, both ways, from each isolate to the polygons that it meets, and to those within ``tolerance``
    times the lesser extent of all; and the new links (focal, neighbor)."""
    lone = as_parts(polygons).join(graph.isolates(), "id", "left_semi")
    size = boxed(as_parts(polygons), F.flatten("parts")).agg((F.max("r") - F.min("l")).alias("w"), (F.max("t") - F.min("b")).alias("h")).first()
    reach = tolerance * min(size["w"] or 0, size["h"] or 0)
    near = candidates(lone, polygons, reach).filter("l_id <> r_id").filter(polygon_distance(F.col("l_parts"), F.col("r_parts")) <= reach + 1e-12)
    near = near.select(F.col("l_id").alias("focal"), F.col("r_id").alias("neighbor"))
    new = near.unionByName(near.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"))).distinct().join(graph.links(), ["focal", "neighbor"], "left_anti")
    return Graph(graph.links().unionByName(new.withColumn("weight", F.lit(1.0))), graph.nodes), new


def voronoi_frames(points: DataFrame, clip: str | DataFrame | None = "bounding_box", margin: float = 0.0) -> DataFrame:
    """id and parts of the points' Voronoi cells. clip: bounding_box (grown by ``margin``); convex_hull; alpha_shape (the
    tightest one that is one piece and holds all points); a table of one polygon; None (the box grown by ten times its size)."""
    from .triangulation import alpha_auto, alpha_polygons, convex_hull

    if clip is None:
        box = points.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
        return voronoi_cells(points, 10 * max(box[2] - box[0], box[3] - box[1], 1e-12))
    cells = voronoi_cells(points, margin)
    if isinstance(clip, str) and clip == "bounding_box":
        return cells
    if isinstance(clip, str) and clip == "convex_hull":
        hull = convex_hull(points).agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("h"))
        clip = hull.select(F.array(F.transform("h", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("parts"))
    elif isinstance(clip, str) and clip == "alpha_shape":
        radius = alpha_auto(points).first()["radius"]
        clip = alpha_polygons(points, 1 / (radius * (1 + 1e-9))).orderBy(F.desc("area")).select("parts").limit(1)
    elif isinstance(clip, str):
        raise ValueError("clip must be bounding_box, convex_hull, alpha_shape, a table of one polygon, or None")
    framed = cells.crossJoin(F.broadcast(clip.select(F.col("parts").alias("frame")).limit(1)))  # one row
    cut = _column(lambda x, y: regions.parts_of(regions.overlay(x, y, "intersection")), PARTS, F.col("parts"), F.col("frame"))
    return framed.select("id", cut.alias("parts"))


def voronoi_contiguity(points: DataFrame, rook: bool = True, clip: str | DataFrame | None = "bounding_box", margin: float = 0.0) -> Graph:
    """Contiguity of the cells of ``voronoi_frames``: of cells that share a side (rook), or a side or a corner.

    Within a box (bounding_box and None) cells are neighbors by the triangulation: they share the side between the two triangles
    at their sites, if it is longer within the box than 1e-9 of the extent. Cells that share a corner are those of the sites on one
    circle. Other clips cut the cells one by one, and their corners are compared on a grid of 1e-7 of the extent."""
    from .builders import contiguity
    from .triangulation import dual

    if clip is None or (isinstance(clip, str) and clip == "bounding_box"):
        if clip is None:
            box = points.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
            margin = 10 * max((box[2] or 0) - (box[0] or 0), (box[3] or 0) - (box[1] or 0), 1e-12)
        sides, box = dual(points, margin)
        pairs = sides.filter((~F.col("point") & (F.col("length") > 1e-9 * max(box[2] - box[0], box[3] - box[1]))) if rook else F.col("length").isNotNull()).select("p", "q")
        if not rook:
            sides, _ = write(sides.filter(F.col("point") & F.col("length").isNotNull()).select("p", "q", "o", "w"))
            pairs = pairs.unionByName(_at_one_corner(sides))
        both = pairs.select(F.col("p").alias("focal"), F.col("q").alias("neighbor")).unionByName(pairs.select(F.col("q").alias("focal"), F.col("p").alias("neighbor")))
        return Graph(both.distinct().withColumn("weight", F.lit(1.0)), points.select("id"))
    box = points.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
    unit = max(box[2] - box[0], box[3] - box[1], 1e-12) * 1e-7
    snap = lambda p: F.struct(*[F.round((p[c] - o) / unit).alias(c) for c, o in (("x", box[0]), ("y", box[1]))])
    snapped = voronoi_frames(points, clip, margin).select("id", F.transform("parts", lambda r: F.transform(r, snap)).alias("parts"))
    return Graph(contiguity(snapped, rook).links(), points.select("id"))


def _at_one_corner(sides: DataFrame) -> DataFrame:
    """All pairs p and q of the sites of one circle. ``sides``: Voronoi sides that are points, between triangles (p, q, o) and
    (p, q, w); triangles that such sides link have one circle."""
    key = lambda *c: F.array_join(F.array_sort(F.array(*[F.col(x).cast("string") for x in c])), "|")
    links = sides.select(key("p", "q", "o").alias("focal"), key("p", "q", "w").alias("neighbor"))
    both = links.unionByName(links.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"))).withColumn("weight", F.lit(1.0))
    labels = Graph(both, both.select(F.col("focal").alias("id")).distinct()).component_labels()
    sites = sides.select(key("p", "q", "o").alias("id"), F.explode(F.array("p", "q", "o")).alias("site")).unionByName(sides.select(key("p", "q", "w").alias("id"), F.explode(F.array("p", "q", "w")).alias("site")))
    sites, _ = write(sites.distinct().join(labels, "id").select("component", "site").distinct())
    return sites.withColumnRenamed("site", "p").join(sites.withColumnRenamed("site", "q"), "component").filter("p < q").select("p", "q")


def buffered(parts: Column, distance: float) -> Column:
    return _column(lambda x: regions.parts_of(regions.buffered(x, distance)), PARTS, parts)


def boundary(parts: Column) -> Column:
    """The rings as closed lines."""
    return F.transform(parts, lambda r: F.concat(r, F.slice(r, 1, 1)))


def polygon_length(parts: Column) -> Column:
    """Length of all rings, holes included."""
    step = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    ring = lambda r: F.aggregate(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), step), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(parts, ring), F.lit(0.0), lambda s, x: s + x)


def envelope(parts: Column) -> Column:
    """The box of a polygon, as one ring."""
    flat = F.flatten(parts)
    get = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    corner = lambda fx, fy: F.struct(get(fx, "x").alias("x"), get(fy, "y").alias("y"))
    return F.array(F.array(corner(F.array_min, F.array_min), corner(F.array_max, F.array_min), corner(F.array_max, F.array_max), corner(F.array_min, F.array_max)))


def hull_of(parts: Column) -> Column:
    """The convex hull of a polygon, as one ring."""

    def hull(rings):
        xy = np.unique(np.concatenate(rings), axis=0) if rings else np.zeros((0, 2))
        half = []
        for line in (xy, xy[::-1]):
            out: list = []
            for p in line:
                while len(out) > 1 and regions._cross(out[-1] - out[-2], p - out[-2]) <= 0:
                    out.pop()
                out.append(p)
            half += out[:-1]
        return regions.parts_of([np.array(half)]) if len(half) > 2 else []

    return _column(hull, PARTS, parts)


def simplify(parts: Column, tolerance: float) -> Column:
    """Rings without the corners that stray from their line by no more than ``tolerance``; rings that vanish are left out."""

    def thin(rings):
        out = []
        for r in rings:
            far = int(np.linalg.norm(r - r[0], axis=1).argmax())
            closed = np.concatenate([r, r[:1]])
            kept = np.concatenate([regions.simplified(closed[: far + 1], tolerance)[:-1], regions.simplified(closed[far:], tolerance)[:-1]])
            out.append(kept)
        return regions.parts_of([r for r in out if len(r) > 2])

    return _column(thin, PARTS, parts)


def is_valid(parts: Column) -> Column:
    """Whether all rings are simple and don't cross each other."""

    def valid(rings):
        return bool(rings) and all(regions.is_simple(r) for r in rings) and not any(regions._properly_cross(regions._sides([a]), regions._sides([b])).any() for k, a in enumerate(rings) for b in rings[k + 1 :])

    return _column(valid, "boolean", parts)


def is_empty(parts: Column) -> Column:
    return F.coalesce(F.size(F.filter(parts, lambda r: F.size(r) > 0)) == 0, F.lit(True))


def is_ring(line: Column) -> Column:
    """Whether a line (array of points) is closed and simple."""

    def ring(lines: pa.Array) -> pa.Array:
        out = []
        for line_ in lines.to_pylist():
            xy = np.array([[p["x"], p["y"]] for p in line_ or []], float).reshape(-1, 2)
            out.append(bool(len(xy) > 3 and (xy[0] == xy[-1]).all() and regions.is_simple(xy[:-1])))
        return pa.array(out, pa.bool_())

    return _arrow(ring, "boolean", line)


def polygon_area(parts: Column) -> Column:
    """Area of the region, holes taken off."""
    return _column(lambda x: float(sum(regions.area(r) for r in regions.oriented(x))), "double", parts)
