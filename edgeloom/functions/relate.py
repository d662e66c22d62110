"""The nine-intersection matrix (DE-9IM) of two regions, or of a point and a region, as a column expression.

Each boundary is cut where it meets the other one. A piece between two cuts lies inside, outside or on the other region, which
the place of its middle tells, and the places just left and right of it tell which interiors and exteriors meet there. All nine
entries follow from the pieces, so there is no rule of its own for each predicate, and every pattern can be asked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as geo

#: Patterns of the named relations (fixed values): one of each list must fit.
PATTERNS = {
    "equals": ["T*F**FFF*"], "disjoint": ["FF*FF****"], "intersects": ["T********", "*T*******", "***T*****", "****T****"],
    "touches": ["FT*******", "F**T*****", "F***T****"], "within": ["T*F**F***"], "contains": ["T*****FF*"],
    "covers": ["T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"], "covered_by": ["T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"],
    "overlaps": ["T*T***T**"],
}
_NEAR = 1e-12  # of a side's length: cuts closer than that are one


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _sides(parts: Column) -> Column:
    each = F.flatten(F.transform(parts, lambda r: F.zip_with(r, geo.closed(r), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))
    return F.filter(each, lambda s: (s["p"]["x"] != s["q"]["x"]) | (s["p"]["y"] != s["q"]["y"]))


def _inside(parts: Column, p: Column) -> Column:
    """In an odd number of rings; the boundary isn't told apart."""
    return F.aggregate(parts, F.lit(False), lambda odd, r: odd != geo.inside_ring(r, p))


def _on(sides: Column, p: Column, reach: Column) -> Column:
    return F.exists(sides, lambda s: geo.segment_point_dist(s["p"], s["q"], p)["dist"] <= reach)


def _cuts(s: Column, other: Column) -> Column:
    """Shares of side ``s``, from 0 to 1, at which it meets the other boundary; along a common stretch, its ends."""
    px, py = s["p"]["x"], s["p"]["y"]
    dx, dy = s["q"]["x"] - px, s["q"]["y"] - py
    length = dx * dx + dy * dy

    def of(t: Column) -> Column:
        ax, ay = t["p"]["x"] - px, t["p"]["y"] - py
        ex, ey = t["q"]["x"] - t["p"]["x"], t["q"]["y"] - t["p"]["y"]
        turn, off = dx * ey - dy * ex, ax * dy - ay * dx
        flat = F.abs(turn) <= _NEAR * F.sqrt(length * (ex * ex + ey * ey))
        along = lambda x, y: (x * dx + y * dy) / length
        crossing = F.array((ax * ey - ay * ex) / F.when(~flat, turn))
        there = (off / F.when(~flat, turn)).between(-_NEAR, 1 + _NEAR)
        stretch = F.when(F.abs(off) <= 1e-9 * length, F.array(along(ax, ay), along(ax + ex, ay + ey)))
        return F.coalesce(F.when(flat, stretch).when(there, crossing), F.array().cast("array<double>"))

    found = F.filter(F.flatten(F.transform(other, of)), lambda u: u.between(-_NEAR, 1 + _NEAR))
    return F.transform(found, lambda u: F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)))


def _pieces(own: Column, other_sides: Column, parts: Column, other: Column) -> Column:
    """For each piece of a boundary: ``on`` and ``inside`` the other region, and whether each region is at its left and right."""

    def of(s: Column) -> Column:
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _cuts(s, other_sides))))
        between = _let(ends, lambda x: F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        pairs = F.filter(between, lambda e: e["b"] - e["a"] > 4 * _NEAR)
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        return F.transform(pairs, lambda e: F.struct(((e["a"] + e["b"]) / 2).alias("u"), (e["b"] - e["a"]).alias("w"), s["p"]["x"].alias("x"), s["p"]["y"].alias("y"), dx.alias("dx"), dy.alias("dy")))

    def told(e: Column) -> Column:
        return _let(_point(e["x"] + e["u"] * e["dx"], e["y"] + e["u"] * e["dy"]), lambda at: seen(e, at))

    def seen(e: Column, at: Column) -> Column:
        step = e["w"] * 1e-6
        left = _point(at["x"] - e["dy"] * step, at["y"] + e["dx"] * step)
        right = _point(at["x"] + e["dy"] * step, at["y"] - e["dx"] * step)
        reach = 1e-9 * e["w"] * F.hypot(e["dx"], e["dy"])
        both = lambda p: F.struct(_inside(parts, p).alias("own"), _inside(other, p).alias("other"))
        return F.struct(_on(other_sides, at, reach).alias("on"), _inside(other, at).alias("inside"), both(left).alias("left"), both(right).alias("right"))

    return F.transform(F.flatten(F.transform(own, of)), told)


def relate(a: Column, b: Column) -> Column:
    """The matrix of two regions (parts: rings, holes by nesting) as nine characters, row by row: interior, boundary and exterior of
    ``a`` against those of ``b``; 2, 1 and 0 for the dimension of what they share, F for nothing. Null for null."""
    shapes = F.struct(a.alias("a"), b.alias("b"), _sides(a).alias("sa"), _sides(b).alias("sb"))

    def pieces(v: Column) -> Column:
        meet = F.exists(v["sa"], lambda s: F.size(_cuts(s, v["sb"])) > 0)
        return F.struct(_pieces(v["sa"], v["sb"], v["a"], v["b"]).alias("a"), _pieces(v["sb"], v["sa"], v["b"], v["a"]).alias("b"), meet.alias("meet"))

    return F.when(a.isNotNull() & b.isNotNull(), _let(_let(shapes, pieces), lambda v: _matrix(v["a"], v["b"], v["meet"])))


def _matrix(pa: Column, pb: Column, meet: Column) -> Column:
    side = lambda f: F.exists(pa, lambda x: f(x["left"]["own"], x["left"]["other"]) | f(x["right"]["own"], x["right"]["other"])) | F.exists(pb, lambda x: f(x["left"]["other"], x["left"]["own"]) | f(x["right"]["other"], x["right"]["own"]))
    entry = lambda there, n: F.when(there, F.lit(n)).otherwise(F.lit("F"))
    within = lambda pieces: F.exists(pieces, lambda x: ~x["on"] & x["inside"])
    beyond = lambda pieces: F.exists(pieces, lambda x: ~x["on"] & ~x["inside"])
    shared = F.when(F.exists(pa, lambda x: x["on"]), F.lit("1")).otherwise(entry(meet, "0"))
    return F.concat(
        entry(side(lambda x, y: x & y), "2"), entry(within(pb), "1"), entry(side(lambda x, y: x & ~y), "2"),
        entry(within(pa), "1"), shared, entry(beyond(pa), "1"),
        entry(side(lambda x, y: ~x & y), "2"), entry(beyond(pb), "1"), F.lit("2"),
    )


def relate_point(p: Column, b: Column) -> Column:
    """As ``relate`` for a point (x, y), which has no boundary, and a region."""
    told = F.struct(_on(_sides(b), p, F.lit(_NEAR)).alias("on"), _inside(b, p).alias("inside"))
    entry = lambda there: F.when(there, F.lit("0")).otherwise(F.lit("F"))
    row = lambda v: F.concat(entry(~v["on"] & v["inside"]), entry(v["on"]), entry(~v["on"] & ~v["inside"]), F.lit("FFF212"))
    return F.when(p.isNotNull() & b.isNotNull(), _let(told, row))


def fits(matrix: Column, pattern: str) -> Column:
    """Whether a matrix fits a pattern of nine characters: T for any dimension, * for anything, else the character itself."""
    if len(pattern) != 9 or set(pattern) - set("TF*012"):
        raise ValueError("a pattern has nine of the characters T, F, *, 0, 1 and 2")
    return matrix.rlike("^" + pattern.replace("*", ".").replace("T", "[012]") + "$")


def holds(matrix: Column, relation: str) -> Column:
    """Whether a matrix of two regions says that they stand in a relation, one of ``PATTERNS``."""
    out = F.lit(False)
    for pattern in PATTERNS[relation]:
        out = out | fits(matrix, pattern)
    return out
