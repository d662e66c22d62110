"""Delaunay triangles of any number of points, in rounds of cells.

Each round parts the points by cuts at quantiles into cells of about ``cell_points``, and triangulates every cell by itself. A triangle whose
circumcircle lies inside its cell holds no point of any other cell, so it is final. A point that final triangles surround is
finished; the others, those near the cells' borders, go to the next round with the final triangles that they have so far
(their wedges), and are parted by other cuts. A triangle of the points that are left is either final itself or lies where final
triangles are already; it lies there if its wedge at a corner is in one of that corner's. So nothing is joined: a round is one
shuffle of its points, and the points of a round shrink with the square root of a cell's size until one cell holds them.

Orientation and in-circle tests are exact: floats with an error bound decide, and integers where they can't. Four points on
one circle are told apart by a rule on their coordinates (as if the least of them, by x and then y, were a trace further
out), so that all cells choose the same diagonals and the triangulation is unique.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, write

CELL_POINTS = 8192
#: Bounds of the errors of the two float determinants, as shares of the sums of their terms' sizes.
_ORIENT_ERROR, _CIRCLE_ERROR = 4e-16, 1.2e-15
_OUTSIDE = -1


def orientation(a, b, p) -> int:
    """Sign of the area of the triangle (a, b, p): 1 if it turns left. Exact."""
    left, right = (a[0] - p[0]) * (b[1] - p[1]), (a[1] - p[1]) * (b[0] - p[0])
    d = left - right
    if abs(d) > _ORIENT_ERROR * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    (ax, ay), (bx, by), (px, py) = ((Fraction(u[0]), Fraction(u[1])) for u in (a, b, p))
    d = (ax - px) * (by - py) - (ay - py) * (bx - px)
    return (d > 0) - (d < 0)


class Triangulation:
    """Triangles of distinct points by insertion. ``corners`` and ``next_to`` hold three entries a triangle: a corner, and the
    triangle opposite it. Triangles outside the hull have the corner -1."""

    def __init__(self, xy: np.ndarray):
        self.xy = list(map(tuple, xy.tolist()))
        self.whole = self._integers(xy)
        self.corners: list[int] = []
        self.next_to: list[int] = []
        self.free: list[int] = []
        order = _curve(xy)
        first = self._first(order)
        if first is None:
            return
        used = set(first)
        at = 0
        for p in order:
            if p not in used:
                at = self._insert(p, at)

    @staticmethod
    def _integers(xy: np.ndarray) -> list[tuple[int, int]]:
        """The coordinates times a power of two that makes them whole."""
        ratios = [(x.as_integer_ratio(), y.as_integer_ratio()) for x, y in xy.tolist()]
        shift = max((q[1].bit_length() for r in ratios for q in r), default=1)
        return [tuple(q[0] << (shift - q[1].bit_length()) for q in r) for r in ratios]

    def turn(self, a: int, b: int, p: int) -> int:
        (ax, ay), (bx, by), (px, py) = self.xy[a], self.xy[b], self.xy[p]
        left, right = (ax - px) * (by - py), (ay - py) * (bx - px)
        d = left - right
        if abs(d) <= _ORIENT_ERROR * (abs(left) + abs(right)):
            (ax, ay), (bx, by), (px, py) = self.whole[a], self.whole[b], self.whole[p]
            d = (ax - px) * (by - py) - (ay - py) * (bx - px)
        return (d > 0) - (d < 0)

    def in_circle(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p is inside the circle of the left-turning triangle (a, b, c)."""
        xy = self.xy
        px, py = xy[p]
        ax, ay, bx, by, cx, cy = xy[a][0] - px, xy[a][1] - py, xy[b][0] - px, xy[b][1] - py, xy[c][0] - px, xy[c][1] - py
        la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        t1, t2, t3, t4, t5, t6 = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        d = la * (t1 - t2) + lb * (t3 - t4) + lc * (t5 - t6)
        if abs(d) > _CIRCLE_ERROR * (la * (abs(t1) + abs(t2)) + lb * (abs(t3) + abs(t4)) + lc * (abs(t5) + abs(t6))):
            return d > 0
        px, py = self.whole[p]
        (ax, ay), (bx, by), (cx, cy) = ((self.whole[k][0] - px, self.whole[k][1] - py) for k in (a, b, c))
        d = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        if d:
            return d > 0
        least = min((a, b, c, p), key=xy.__getitem__)
        if least == p:
            return False
        if least == a:
            return self.turn(p, b, c) > 0
        return self.turn(a, p, c) > 0 if least == b else self.turn(a, b, p) > 0

    def _first(self, order: list[int]) -> tuple[int, int, int] | None:
        """The first triangle and the three outside ones round it; None if all points lie on a line."""
        if len(order) < 3:
            return None
        a, b = order[:2]
        for c in order[2:]:
            side = self.turn(a, b, c)
            if side:
                if side < 0:
                    a, b = b, a
                self.corners = [a, b, c, c, b, _OUTSIDE, a, c, _OUTSIDE, b, a, _OUTSIDE]
                self.next_to = [1, 2, 3, 3, 2, 0, 1, 3, 0, 2, 1, 0]
                return a, b, c
        return None

    def _conflict(self, t: int, p: int) -> bool:
        a, b, c = self.corners[3 * t : 3 * t + 3]
        if a >= 0 and b >= 0 and c >= 0:
            return self.in_circle(a, b, c, p)
        if a < 0:
            a, b = b, c
        elif b < 0:
            a, b = c, a
        side = self.turn(a, b, p)
        if side:
            return side > 0
        (ax, ay), (bx, by), (px, py) = self.whole[a], self.whole[b], self.whole[p]
        return (ax - px) * (bx - px) + (ay - py) * (by - py) < 0

    def _insert(self, p: int, at: int) -> int:
        corners, next_to = self.corners, self.next_to
        t = at
        if min(corners[3 * t : 3 * t + 3]) < 0:
            t = next_to[3 * t + corners.index(_OUTSIDE, 3 * t, 3 * t + 3) - 3 * t]
        before = -1
        while True:  # walk to a triangle that holds p, or is outside and sees it
            a, b, c = corners[3 * t : 3 * t + 3]
            if a < 0 or b < 0 or c < 0:
                break
            for k, (u, v) in enumerate(((b, c), (c, a), (a, b))):
                n = next_to[3 * t + k]
                if n != before and self.turn(u, v, p) < 0:
                    before, t = t, n
                    break
            else:
                break
        bad, stack, border = {t}, [t], []
        while stack:
            t = stack.pop()
            a, b, c = corners[3 * t : 3 * t + 3]
            for k, side in enumerate(((b, c), (c, a), (a, b))):
                n = next_to[3 * t + k]
                if n in bad:
                    continue
                if self._conflict(n, p):
                    bad.add(n)
                    stack.append(n)
                else:
                    border.append((*side, n, t))
        self.free += bad
        starts, ends, made = {}, {}, []
        for u, v, outer, inner in border:
            if self.free:
                t = self.free.pop()
            else:
                t = len(corners) // 3
                corners += (0, 0, 0)
                next_to += (0, 0, 0)
            starts[u] = ends[v] = t
            made.append((t, u, v, outer, inner))
        for t, u, v, outer, inner in made:
            k = next(3 * outer + i for i in range(3) if next_to[3 * outer + i] == inner and corners[3 * outer + (i + 1) % 3] == v)
            next_to[k] = -2 - t  # set below: freed numbers are used again
        for t, u, v, outer, _ in made:
            corners[3 * t : 3 * t + 3] = (u, v, p)
            next_to[3 * t : 3 * t + 3] = (starts[v], ends[u], outer)
            k = next(3 * outer + i for i in range(3) if next_to[3 * outer + i] == -2 - t)
            next_to[k] = t
        return made[0][0]

    def triangles(self) -> np.ndarray:
        """Corners of the triangles inside the hull, turning left."""
        all_ = np.array(self.corners, np.int64).reshape(-1, 3)
        live = np.ones(len(all_), bool)
        live[self.free] = False
        return all_[live & (all_ >= 0).all(1)]


def _curve(xy: np.ndarray) -> list[int]:
    """An order in which points that follow each other are close: places on a Hilbert curve."""
    low, span = xy.min(0, initial=np.inf), 1.0
    if not len(xy):
        return []
    span = max(float(np.ptp(xy, axis=0).max()), 1e-300)
    x, y = (((xy - low) / span) * 65535).astype(np.int64).T
    place = np.zeros(len(xy), np.int64)
    s = 1 << 15
    while s:
        rx, ry = ((x & s) > 0).astype(np.int64), ((y & s) > 0).astype(np.int64)
        place += s * s * ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, 65535 - x, x), np.where(flip, 65535 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        s >>= 1
    return np.lexsort((xy[:, 1], xy[:, 0], place)).tolist()


def inside(xy: np.ndarray, triangles: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which triangles' circles lie inside the open box. Flat triangles, whose circles floats don't give well, count as outside
    unless the box has no ends."""
    if all(np.isinf(box)):
        return np.ones(len(triangles), bool)
    a, b, c = (xy[triangles[:, k]] for k in range(3))
    b, c = b - a, c - a
    twice = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    lb, lc, la = (b * b).sum(1), (c * c).sum(1), ((b - c) ** 2).sum(1)
    longest = np.maximum(np.maximum(la, lb), lc)
    good = twice > 1e-6 * longest
    d = np.where(good, twice, 1)
    ux, uy = (c[:, 1] * lb - b[:, 1] * lc) / d, (b[:, 0] * lc - c[:, 0] * lb) / d
    r = np.hypot(ux, uy) * (1 + 1e-6)
    x, y = a[:, 0] + ux, a[:, 1] + uy
    return good & (x - r > box[0]) & (y - r > box[1]) & (x + r < box[2]) & (y + r < box[3])


def covered(u, v, wedges: np.ndarray) -> bool:
    """Whether the direction just left of u to v is in one of u's wedges (ax, ay, bx, by: from u to a, turning left to b)."""
    for ax, ay, bx, by in wedges.reshape(-1, 4).tolist():
        if (ax, ay) == v:
            return True
        if (bx, by) == v:
            continue
        side = orientation(u, (ax, ay), v)
        if side < 0 or (side == 0 and (ax - u[0]) * (v[0] - u[0]) + (ay - u[1]) * (v[1] - u[1]) < 0):
            continue
        if orientation(u, v, (bx, by)) > 0:
            return True
    return False


def triangulate_cell(xy: np.ndarray, wedges: list, box: tuple[float, float, float, float]) -> tuple[np.ndarray, list]:
    """Final triangles of one cell (rows of ``xy``), and for each point its wedges, or None if it is finished."""
    tri = Triangulation(xy).triangles()
    tri = tri[inside(xy, tri, box)]
    places = list(map(tuple, xy.tolist()))
    have = np.array([len(w) > 0 for w in wedges], bool)
    if have.any() and len(tri):
        keep = np.ones(len(tri), bool)
        for k in np.flatnonzero(have[tri].any(1)).tolist():
            t = tri[k].tolist()
            i = next(i for i in range(3) if have[t[i]])
            keep[k] = not covered(places[t[i]], places[t[(i + 1) % 3]], wedges[t[i]])
        tri = tri[keep]
    corner = tri.ravel()
    rest = np.concatenate([xy[np.roll(tri, -1, 1).ravel()], xy[np.roll(tri, -2, 1).ravel()]], 1)
    order = np.argsort(corner, kind="stable")
    cuts = np.searchsorted(corner[order], np.arange(len(xy) + 1))
    left: list = []
    for i in range(len(xy)):
        new = rest[order[cuts[i] : cuts[i + 1]]]
        mine = np.concatenate([np.reshape(wedges[i], (-1, 4)), new]) if have[i] else new
        starts, ends = set(map(tuple, mine[:, :2].tolist())), set(map(tuple, mine[:, 2:].tolist()))
        left.append(None if len(mine) and starts == ends else mine.ravel())
    return tri, left


class Cells:
    """Cells of one round: cuts along one axis, and cuts along the other one in each strip."""

    def __init__(self, sample: np.ndarray, axis: int, cells: int, earlier: np.ndarray | None):
        self.axis = axis
        strips = max(1, round(cells**0.5))
        rows = max(1, -(-cells // strips))
        sample = sample[:, [axis, 1 - axis]]
        self.outer = self._cuts(sample[:, 0], strips, None)
        which = np.searchsorted(self.outer, sample[:, 0], side="right")
        self.inner = [self._cuts(sample[which == k, 1], rows, earlier) for k in range(len(self.outer) + 1)]
        self.first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.inner])])

    @staticmethod
    def _cuts(values: np.ndarray, parts: int, earlier: np.ndarray | None) -> np.ndarray:
        """Quantiles, moved to the middle between earlier cuts, along which the points left by an earlier round lie."""
        if parts < 2 or not len(values):
            return np.zeros(0)
        cuts = np.quantile(values, np.arange(1, parts) / parts)
        if earlier is not None and len(earlier):
            ends = np.concatenate([[values.min()], earlier, [values.max()]])
            k = np.searchsorted(earlier, cuts)
            cuts = (ends[k] + ends[k + 1]) / 2
        return np.unique(cuts)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u, v = (x, y) if self.axis == 0 else (y, x)
        strip = np.searchsorted(self.outer, u, side="right")
        out = np.zeros(len(u), np.int64)
        for k in np.unique(strip).tolist():
            at = strip == k
            out[at] = self.first[k] + np.searchsorted(self.inner[k], v[at], side="right")
        return out

    def box(self, cell: int) -> tuple[float, float, float, float]:
        strip = int(np.searchsorted(self.first, cell, side="right")) - 1
        ends = []
        for cuts, k in ((self.outer, strip), (self.inner[strip], cell - int(self.first[strip]))):
            ends.append((cuts[k - 1] if k else -np.inf, cuts[k] if k < len(cuts) else np.inf))
        (l, r), (b, t) = ends if self.axis == 0 else ends[::-1]
        return float(l), float(b), float(r), float(t)


def _round(plan: Cells, places: list[str]):
    """The functions of a round: points with their cells, and the triangles and points left of a cell."""

    def dealt(batches):
        for pdf in batches:
            yield pdf.assign(cell=plan.of(pdf["x"].to_numpy(), pdf["y"].to_numpy()))

    def run(key, rows):
        rows = rows.sort_by([("x", "ascending"), ("y", "ascending")]).combine_chunks()
        xy = np.stack([rows.column(c).to_numpy() for c in "xy"], 1)
        final, left = triangulate_cell(xy, [np.array(w) for w in rows.column("wedges").to_pylist()], plan.box(key[0].as_py()))
        rest, n = [i for i, w in enumerate(left) if w is not None], len(final)
        ids, kind, real = rows.column("id").combine_chunks(), rows.schema.field("id").type, pa.float64()
        out = {c: pa.concat_arrays([ids.take(pa.array(final[:, k], pa.int64())), pa.nulls(len(rest), kind)]) for k, c in enumerate("abc")}
        out |= {c: pa.concat_arrays([pa.array(xy[final[:, k // 2], k % 2], real), pa.nulls(len(rest), real)]) for k, c in enumerate(places)}
        out["id"] = pa.concat_arrays([pa.nulls(n, kind), ids.take(pa.array(rest, pa.int64()))])
        out |= {c: pa.concat_arrays([pa.nulls(n, real), pa.array(xy[rest, k], real)]) for k, c in enumerate("xy")}
        out["wedges"] = pa.array([None] * n + [left[i].tolist() for i in rest], pa.list_(real))
        return pa.table(out)

    return dealt, run


def triangles(points: DataFrame, cell_points: int = CELL_POINTS, most_points: int = 4_000_000) -> DataFrame:
    """a, b, c (ids, turning left) and ax, ay, bx, by, cx, cy of the Delaunay triangles of distinct places; of points at one place that with the least id
    takes part. Points without coordinates are left out. No triangles if all points lie on one line.

    A round that leaves most of its points (many of them on their hull or on one line) makes the next one's cells larger; a cell
    of over ``most_points`` such points is an error.
    """
    kind = dict(points.dtypes)["id"]
    spark = points.sparkSession
    at = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "id").filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    todo, path = write(at.groupBy("x", "y").agg(F.min("id").alias("id")).withColumn("wedges", F.array().cast("array<double>")))
    n, size, turn, earlier, done = todo.count(), cell_points, 0, None, []
    places = [f"{c}{d}" for c in "abc" for d in "xy"]
    made = f"a {kind}, b {kind}, c {kind}, " + ", ".join(f"{c} double" for c in places)
    schema = f"{made}, id {kind}, x double, y double, wedges array<double>"
    while n:
        cells = -(-n // size)
        if cells == 1 and n > most_points:
            raise ValueError(f"{n} points lie on their hull or on lines that no cell parts; {most_points} at most")
        if cells == 1:
            plan = Cells(np.zeros((0, 2)), turn % 2, 1, None)
        else:  # a sample for the cuts only, as for any partition by ranges
            some = todo.select("x", "y").sample(min(1.0, min(200 * cells, 1_000_000) / n), 7).toPandas().to_numpy()
            plan = Cells(some, turn % 2, cells, earlier)

        dealt, run = _round(plan, places)
        cell = todo.mapInPandas(dealt, f"x double, y double, id {kind}, wedges array<double>, cell bigint")
        out, out_path = write(cell.groupBy("cell").applyInArrow(run, schema))
        remove(spark, path)
        done.append(out.filter("a IS NOT NULL").select("a", "b", "c", *places))
        if cells == 1:
            break
        rest, path = write(out.filter("id IS NOT NULL").select("x", "y", "id", "wedges"))
        left = rest.count()
        if left > n // 2:
            size *= 4
        todo, n, turn, earlier = rest, left, turn + 1, plan.outer
    if not done:
        return spark.createDataFrame([], made)
    return reduce(DataFrame.unionByName, done)
