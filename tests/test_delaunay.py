"""The triangulation in rounds of cells: the same triangles whatever the cells, exact on ties, and its dual."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import delaunay, shapes, triangulation

SETS = {
    "uniform": lambda rng: rng.random((900, 2)),
    "heavy tails": lambda rng: rng.standard_cauchy((700, 2)),
    "grid": lambda rng: np.array([(i, j) for i in range(25) for j in range(25)], float),
    "shifted grid": lambda rng: np.array([(1e6 + i * 0.1, 1e6 + j * 0.1) for i in range(25) for j in range(25)]),
    "clusters": lambda rng: np.concatenate([rng.normal(c, 1e-3, (200, 2)) for c in ((0, 0), (1, 1), (1, 0))]),
    "line and a point": lambda rng: np.array([*[(k, 2 * k) for k in range(120)], (3, 50)], float),
}


def points(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id bigint, x double, y double")


def found(df):
    return {min(t, (*t[1:], t[0]), (t[2], *t[:2])) for t in (tuple(r) for r in df.select("a", "b", "c").collect())}


@pytest.mark.parametrize("name", SETS)
def test_cells_do_not_change_the_triangles(spark, name):
    xy = SETS[name](np.random.default_rng(5))
    frame = points(spark, xy)
    one = found(delaunay.triangles(frame))
    assert found(delaunay.triangles(frame, cell_points=120)) == one
    places = delaunay.Triangulation(xy)
    assert {min(t, (*t[1:], t[0]), (t[2], *t[:2])) for t in map(tuple, places.triangles().tolist())} == one
    corners = xy[np.array(sorted(one))]
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() / 2
    hull = triangulation.convex_hull(frame).orderBy("ord").select("x", "y").toPandas().to_numpy()
    hull = hull - hull[0]
    nxt = np.roll(hull, -1, 0)
    assert area == pytest.approx((hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1]).sum() / 2, rel=1e-6)
    for k, (p, q, r) in enumerate(sorted(one)):  # no point inside a circle, exactly
        if k % 40 == 0:
            assert not any(_strictly_inside(xy, p, q, r, o) for o in range(len(xy)) if o not in (p, q, r))


def _strictly_inside(xy, p, q, r, o):
    from fractions import Fraction

    (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(u)) - Fraction(float(v)) for u, v in zip(xy[k], xy[o], strict=True)] for k in (p, q, r))
    return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def test_few_flat_missing_and_shared_places(spark):
    assert delaunay.triangles(points(spark, [])).count() == 0
    assert delaunay.triangles(points(spark, [(0, 0), (1, 1)])).count() == 0
    assert delaunay.triangles(points(spark, [(k, k) for k in range(100)]), cell_points=10).count() == 0
    frame = spark.createDataFrame([(9, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, None, 0.0), (5, float("nan"), 1.0)], "id bigint, x double, y double")
    assert found(delaunay.triangles(frame)) == {(1, 2, 3)}
    with pytest.raises(ValueError, match="hull"):
        delaunay.triangles(points(spark, [(k, k * k) for k in range(60)]), cell_points=10, most_points=50)


def test_text_ids(spark):
    frame = points(spark, [(0, 0), (2, 0), (0, 2), (3, 3)]).withColumn("id", F.concat(F.lit("n"), F.col("id").cast("string")))
    assert found(delaunay.triangles(frame)) == {("n0", "n1", "n2"), ("n1", "n3", "n2")}


def test_rounds_shrink_and_no_task_holds_all(spark):
    """A cell's task gets its own points only, and each round a fraction of those before."""
    rng = np.random.default_rng(1)
    xy = rng.random((20_000, 2))
    plan = delaunay.Cells(xy, 0, 20, None)
    cell = plan.of(xy[:, 0], xy[:, 1])
    assert np.bincount(cell).max() < 2 * 20_000 / 20
    left = 0
    for k in np.unique(cell).tolist():
        mine = xy[cell == k]
        _, rest = delaunay.triangulate_cell(mine, [np.zeros(0)] * len(mine), plan.box(k))
        left += sum(w is not None for w in rest)
    assert left < 0.4 * len(xy)


def test_voronoi_of_a_grid(spark):
    xy = [(i + 0.0, j + 0.0) for i in range(6) for j in range(6)]
    frame = points(spark, xy)
    pairs = lambda g: {(r[0], r[1]) for r in g.links().filter("weight > 0").select("focal", "neighbor").collect()}
    rook = {(a, b) for a in range(36) for b in range(36) if abs(a // 6 - b // 6) + abs(a % 6 - b % 6) == 1}
    queen = {(a, b) for a in range(36) for b in range(36) if a != b and max(abs(a // 6 - b // 6), abs(a % 6 - b % 6)) == 1}
    for clip in ("bounding_box", None):
        assert pairs(shapes.voronoi_contiguity(frame, clip=clip)) == rook
        assert pairs(shapes.voronoi_contiguity(frame, rook=False, clip=clip)) == queen
    ring = [(np.cos(t), np.sin(t)) for t in np.arange(4) * np.pi / 2] + [(3.0, 0.0), (-3.0, 0.5)]
    assert pairs(queen_of(spark, [(1, 0), (0, 1), (-1, 0), (0, -1), (0.6, 0.8), (0.8, -0.6)])) >= {(0, 2), (1, 3)}
    assert pairs(triangulation.triangulation(points(spark, ring), "voronoi")) <= pairs(triangulation.triangulation(points(spark, ring)))


def queen_of(spark, xy):
    return shapes.voronoi_contiguity(points(spark, xy), rook=False, margin=1.0)


def test_voronoi_cells_tile_the_box(spark):
    rng = np.random.default_rng(2)
    frame = points(spark, rng.random((300, 2)))
    cells = shapes.voronoi_frames(frame)
    box = frame.agg((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).first()[0]
    assert cells.count() == 300 and cells.select(F.sum(shapes.polygon_area(F.col("parts")))).first()[0] == pytest.approx(box, rel=1e-9)
    sides, _ = triangulation.dual(frame, 0.0)
    rook = shapes.voronoi_contiguity(frame)
    assert rook.links().count() == 2 * sides.filter("length > 1e-9").count()


def test_gabriel_of_a_hub(spark):
    """A centre among many points on a circle: no pairs of its links are made."""
    turn = np.random.default_rng(3).random(400) * 2 * np.pi
    frame = points(spark, [(0.0, 0.0), *zip(np.cos(turn), np.sin(turn), strict=True)])
    g = triangulation.triangulation(frame, "gabriel")
    e = {(r[0], r[1]) for r in g.links().filter("weight > 0").collect()}
    xy = frame.orderBy("id").select("x", "y").toPandas().to_numpy()
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    want = {(i, j) for i in range(401) for j in range(401) if i != j and not (np.delete(d[i] + d[j], [i, j]) < d[i, j] - 1e-12).any()}
    assert e == want


def test_rings_and_holes(spark):
    """An annulus with an island in it, and two parts that meet in one point: rings in order, holes of their own outer ring."""
    rng = np.random.default_rng(9)
    xy = rng.uniform(-3, 3, (6000, 2))
    r = np.hypot(*xy.T)
    xy = np.concatenate([xy[((r > 1.5) & (r < 2.8)) | (r < 0.7)], rng.uniform(5, 6, (300, 2))])
    parts = triangulation.alpha_polygons(points(spark, xy), 1 / 0.3).collect()
    assert sorted(len(p["parts"]) for p in parts) == [1, 1, 2] and sorted(p["part"] for p in parts) == [0, 1, 2]
    kept = delaunay.triangles(points(spark, xy)).toPandas()
    a, b, c = (kept[[f"{k}x", f"{k}y"]].to_numpy() for k in "abc")
    twice = (b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]
    size = [np.linalg.norm(p - q, axis=1) for p, q in ((a, b), (b, c), (a, c))]
    inside = size[0] * size[1] * size[2] / (2 * twice) < 0.3
    assert sum(p["area"] for p in parts) == pytest.approx(twice[inside].sum() / 2)
    for p in parts:
        ring = np.array(p["parts"][0])
        assert len(ring) == len(np.unique(ring, axis=0))
        want = sum(abs(shoelace(np.array(x))) * (1 if k == 0 else -1) for k, x in enumerate(p["parts"]))
        assert p["area"] == pytest.approx(want)
    bow = [(0, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    frame = spark.createDataFrame([(tuple(map(float, (0, *bow[i]))), tuple(map(float, (0, *bow[j])))) for i, j in ((0, 2), (2, 1), (1, 0), (0, 3), (3, 4), (4, 0))], "u struct<id:double,x:double,y:double>, v struct<id:double,x:double,y:double>")
    frame = frame.select(*[F.struct(F.concat_ws(",", F.col(f"{c}.x"), F.col(f"{c}.y")).alias("id"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")).alias(c) for c in "uv"])
    assert sorted(round(r["ring_area"], 9) for r in triangulation.rings_of(frame).collect()) == [1, 1]


def shoelace(ring):
    nxt = np.roll(ring, -1, 0)
    return (ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() / 2
