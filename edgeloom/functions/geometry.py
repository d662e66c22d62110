"""Planar geometry as column expressions. A ring is array<struct<x,y>> without its first point repeated at the end;
a polygon is an array of rings whose ``holes`` have their own column, or none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def closed(ring: Column) -> Column:
    """Next vertex of each vertex."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def points_dist(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def signed_area(ring: Column) -> Column:
    return _total(F.zip_with(ring, closed(ring), _cross)) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.zip_with(ring, closed(ring), points_dist))


def chain_length(chain: Column) -> Column:
    return _total(F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain)), points_dist))


def centroid(ring: Column) -> Column:
    a = signed_area(ring)
    part = lambda c: _total(F.zip_with(ring, closed(ring), lambda p, q: (p[c] + q[c]) * _cross(p, q))) / (6 * a)
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def bbox(ring: Column) -> Column:
    get = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(get(F.array_min, "x").alias("left"), get(F.array_min, "y").alias("lower"), get(F.array_max, "x").alias("right"), get(F.array_max, "y").alias("upper"))


def bbox_overlap(a: Column, b: Column) -> Column:
    return ~((b["left"] > a["right"]) | (b["right"] < a["left"]) | (b["lower"] > a["upper"]) | (b["upper"] < a["lower"]))


def is_clockwise(ring: Column) -> Column:
    return F.when(F.size(ring) < 3, True).otherwise(signed_area(ring) < 0)


def ccw(ring: Column) -> Column:
    return ~is_clockwise(ring)


def orientation(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def is_collinear(a: Column, b: Column, c: Column) -> Column:
    return F.abs(orientation(a, b, c)) < 3 * EPS


def seg_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd cross, by orientations (touching ends don't count)."""
    turn = lambda p, q, r: (r["y"] - p["y"]) * (q["x"] - p["x"]) > (q["y"] - p["y"]) * (r["x"] - p["x"])
    return (turn(a, c, d) != turn(b, c, d)) & (turn(a, b, c) != turn(a, b, d))


def segments_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The common point of segments ab and cd, or null (also if they are parallel)."""
    den = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
    t = F.try_divide((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"]), den)
    u = F.try_divide((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"]), den)
    hit = t.between(0, 1) & u.between(0, 1)
    return F.when(hit, F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))


def segment_point_dist(a: Column, b: Column, p: Column) -> Column:
    """Distance from p to segment ab, and the ratio along the segment of its nearest point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    r = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    return F.struct(F.hypot(p["x"] - a["x"] - r * dx, p["y"] - a["y"] - r * dy).alias("dist"), r.alias("ratio"))


def on_boundary(ring: Column, p: Column) -> Column:
    touches = lambda a, b: (F.abs(orientation(a, b, p)) <= 1e-12) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return F.exists(F.zip_with(ring, closed(ring), touches), lambda x: x)


def inside_ring(ring: Column, p: Column) -> Column:
    """Half-open crossing rule; points on the boundary are not told apart here."""
    crosses = lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])
    return F.aggregate(F.zip_with(ring, closed(ring), crosses), F.lit(False), lambda acc, x: acc != F.coalesce(x, F.lit(False)))


def contains_point(ring: Column, p: Column, holes: Column | None = None) -> Column:
    """In the ring or on its boundary, and in none of the holes."""
    found = inside_ring(ring, p) | on_boundary(ring, p)
    if holes is not None:
        found = found & ~F.exists(holes, lambda h: inside_ring(h, p) & ~on_boundary(h, p))
    return found


def ring_point_dist(ring: Column, p: Column) -> Column:
    """0 inside, else the distance to the nearest side."""
    return F.when(contains_point(ring, p), 0.0).otherwise(F.array_min(F.zip_with(ring, closed(ring), lambda a, b: segment_point_dist(a, b, p)["dist"])))


def polygon_area(rings: Column, holes: Column | None = None) -> Column:
    area = _total(F.transform(rings, ring_area))
    return area if holes is None else area - _total(F.transform(holes, ring_area))


def rectangle_intersection(a: Column, b: Column) -> Column:
    """Common box of two boxes, with its kind (rectangle, segment or point), or null."""
    left, lower = F.greatest(a["left"], b["left"]), F.greatest(a["lower"], b["lower"])
    right, upper = F.least(a["right"], b["right"]), F.least(a["upper"], b["upper"])
    kind = F.when((left == right) & (lower == upper), "point").when((left == right) | (lower == upper), "segment").otherwise("rectangle")
    return F.when((left <= right) & (lower <= upper), F.struct(left.alias("left"), lower.alias("lower"), right.alias("right"), upper.alias("upper"), kind.alias("kind")))


def angle_between(o: Column, p: Column, q: Column) -> Column:
    """Signed angle at o from p to q."""
    return F.atan2((p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"]), (p["x"] - o["x"]) * (q["x"] - o["x"]) + (p["y"] - o["y"]) * (q["y"] - o["y"]))


def point_at(o: Column, p: Column, angle: Column, dist: Column) -> Column:
    """The point at ``dist`` from o, turned by ``angle`` from the ray o to p."""
    base = F.atan2(p["y"] - o["y"], p["x"] - o["x"]) + angle
    return F.struct((o["x"] + dist * F.cos(base)).alias("x"), (o["y"] + dist * F.sin(base)).alias("y"))


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius of the circle through three points; half the longest side if they are collinear."""
    x, y, z = points_dist(b, c), points_dist(a, c), points_dist(a, b)
    return F.coalesce(F.try_divide(x * y * z, 2 * F.abs(orientation(a, b, c))), F.greatest(x, y, z) / 2)


def shape_attributes(ring: Column) -> dict[str, Column]:
    return {"area": ring_area(ring), "perimeter": perimeter(ring), "centroid": centroid(ring), "bbox": bbox(ring), "len": F.size(ring), "vertices": ring}


def point_on_segment(a: Column, b: Column, p: Column, tolerance: float = 1e-12) -> Column:
    """p if it lies on segment ab, else null."""
    return F.when(segment_point_dist(a, b, p)["dist"] <= tolerance, p)


def rectangle_contains(box: Column, p: Column) -> Column:
    """Whether p is in a box or on its edge."""
    return p["x"].between(box["left"], box["right"]) & p["y"].between(box["lower"], box["upper"])


def touches_rectangle(p: Column, box: Column) -> Column:
    """1 where p is in a box or on its edge, else 0."""
    return rectangle_contains(box, p).cast("int")


def rectangle(left: Column, lower: Column, right: Column, upper: Column) -> Column:
    return F.struct(left.alias("left"), lower.alias("lower"), right.alias("right"), upper.alias("upper"))


def rectangle_measures(box: Column) -> dict[str, Column]:
    width, height = box["right"] - box["left"], box["upper"] - box["lower"]
    return {"width": width, "height": height, "area": width * height, "centre": F.struct(((box["left"] + box["right"]) / 2).alias("x"), ((box["lower"] + box["upper"]) / 2).alias("y"))}


def moved_to(box: Column, centre: Column) -> Column:
    """The box with another centre."""
    m = rectangle_measures(box)
    return rectangle(centre["x"] - m["width"] / 2, centre["y"] - m["height"] / 2, centre["x"] + m["width"] / 2, centre["y"] + m["height"] / 2)


def scaled(box: Column, factor: Column) -> Column:
    """The box grown by a factor about its centre."""
    m = rectangle_measures(box)
    w, h = m["width"] * factor / 2, m["height"] * factor / 2
    return rectangle(m["centre"]["x"] - w, m["centre"]["y"] - h, m["centre"]["x"] + w, m["centre"]["y"] + h)


def ray_segment_intersection(o: Column, p: Column, a: Column, b: Column) -> Column:
    """The common point of segment ab and the ray from o through p, or null: the ray is cut beyond the segment's ends."""
    reach = F.greatest(points_dist(a, o), points_dist(b, o)) + 1
    ratio = F.try_divide(reach, points_dist(o, p))
    return segments_intersection(a, b, o, F.struct((o["x"] + ratio * (p["x"] - o["x"])).alias("x"), (o["y"] + ratio * (p["y"] - o["y"])).alias("y")))


def line(m: Column, b: Column) -> Column:
    """The line y = m x + b."""
    return F.struct(m.alias("m"), b.alias("b"))


def line_y(ln: Column, x: Column) -> Column:
    return ln["m"] * x + ln["b"]


def line_x(ln: Column, y: Column) -> Column:
    """Null for a level line."""
    return F.try_divide(y - ln["b"], ln["m"])


def segment_line(a: Column, b: Column) -> Column:
    """The line through a segment; null slope and intercept if it is vertical (then x is a's)."""
    m = F.try_divide(b["y"] - a["y"], b["x"] - a["x"])
    return F.struct(m.alias("m"), (a["y"] - m * a["x"]).alias("b"), F.when(b["x"] == a["x"], a["x"]).alias("x"))


def segment_swap(a: Column, b: Column) -> Column:
    return F.struct(b.alias("a"), a.alias("b"))


def segment_turn(a: Column, b: Column, p: Column) -> Column:
    """1 where p lies counter-clockwise of segment ab, -1 clockwise, 0 on its line."""
    return F.signum(orientation(a, b, p)).cast("int")


def chain_segments(chain: Column) -> Column:
    return F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain)), lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def lonlat(points: Column) -> Column:
    """Points as (lat, lon) from (lon, lat), or back: the two coordinates change places."""
    return F.transform(points, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def from_geojson(text: Column) -> Column:
    """Parts of a GeoJSON geometry or feature: a point's or line's positions as one part, rings of polygons without their
    closing position; null for other texts."""
    shape = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind, body = F.get_json_object(shape, "$.type"), F.get_json_object(shape, "$.coordinates")
    xy = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    open_ = lambda r: F.slice(F.transform(r, xy), 1, F.greatest(F.size(r) - 1, F.lit(0)))
    point = F.array(F.array(xy(F.from_json(body, "array<double>"))))
    lines = F.from_json(body, "array<array<double>>")
    rings = F.from_json(body, "array<array<array<double>>>")
    many = F.flatten(F.from_json(body, "array<array<array<array<double>>>>"))
    return (
        F.when(kind == "Point", point).when(kind.isin("LineString", "MultiPoint"), F.array(F.transform(lines, xy)))
        .when(kind == "MultiLineString", F.transform(rings, lambda r: F.transform(r, xy)))
        .when(kind == "Polygon", F.transform(rings, open_)).when(kind == "MultiPolygon", F.transform(many, open_))
    )
