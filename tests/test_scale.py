"""Quantiles of distances without the pairs, boxes of all sizes, nearest points with outliers: exact, and with bounded rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import boxes, builders, distances, joins, polygons, shapes


def points(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id bigint, x double, y double")


def rect(id_, l, b, r, t):
    return (id_, [[(l, b), (r, b), (r, t), (l, t)]])


def shaped(spark, rows):
    return spark.createDataFrame(rows, "id bigint, parts array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("kind", ["uniform", "one far point", "copies", "two clusters"])
def test_distance_quantile(spark, kind):
    rng = np.random.default_rng(4)
    xy = {
        "uniform": lambda: rng.random((300, 2)),
        "one far point": lambda: np.concatenate([rng.random((200, 2)), [(1e9, 1e9)]]),
        "copies": lambda: rng.integers(0, 4, (150, 2)).astype(float),
        "two clusters": lambda: np.concatenate([rng.normal(0, 1e-3, (100, 2)), rng.normal(5, 1e-3, (120, 2))]),
    }[kind]()
    frame, n = points(spark, xy), len(xy)
    for p, q in ((2, 0.25), (np.inf, 0.9)) if kind == "uniform" else ((2, 0.25),):
        d = np.linalg.norm(xy[:, None] - xy[None], ord=p, axis=2)[~np.eye(n, dtype=bool)]
        assert distances.distance_quantile(frame, q, p=p, enough=1500) == pytest.approx(np.quantile(d, q), rel=1e-9, abs=1e-12)


def test_distance_quantile_of_few_and_of_spheres(spark):
    assert distances.distance_quantile(points(spark, [(1, 1)]), 0.5) is None
    assert distances.distance_quantile(points(spark, [(0, 0), (3, 4)]), 0.25) == 5
    rng = np.random.default_rng(2)
    frame = points(spark, np.stack([rng.uniform(-180, 180, 120), rng.uniform(-80, 80, 120)], 1)).withColumnsRenamed({"x": "lon", "y": "lat"})
    want = builders.all_pairs(frame, None, ("lon", "lat")).toPandas()["distance"]
    assert distances.distance_quantile(frame, 0.25, ("lon", "lat"), None, enough=300) == pytest.approx(np.quantile(want, 0.25), rel=1e-9)


def test_default_bandwidth_makes_no_pairs_beyond_it(spark):
    xy = np.random.default_rng(1).random((80, 2))
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    h = np.quantile(d[~np.eye(80, dtype=bool)], 0.25)
    links = builders.kernel(points(spark, xy)).links()
    assert "Cartesian" not in links._jdf.queryExecution().toString() and "NestedLoop" not in links._jdf.queryExecution().toString()
    got = {(r[0], r[1]): r[2] for r in links.collect()}
    assert set(got) == {(i, j) for i in range(80) for j in range(80) if i != j and d[i, j] <= h}
    assert all(w == pytest.approx(np.exp(-((d[k] / h) ** 2) / 2) / np.sqrt(2 * np.pi)) for k, w in got.items())


def test_box_join_is_exact(spark):
    rng = np.random.default_rng(3)
    size = lambda n: 2.0 ** rng.uniform(-6, 8, n)
    sets = []
    for n in (90, 70):
        x, y, w, h = rng.uniform(-100, 100, n), rng.uniform(-100, 100, n), size(n), size(n)
        sets.append([(k, *map(float, v)) for k, v in enumerate(zip(x, y, x + w, y + h, strict=True))] + [(n, 5.0, 5.0, 5.0, 5.0), (n + 1, -1e6, 0.0, 1e6, 0.0)])
    left, right = (spark.createDataFrame(rows, ", ".join(f"{p}_{c} {'bigint' if c == 'id' else 'double'}" for c in ("id", "l", "b", "r", "t"))) for rows, p in zip(sets, "lr", strict=True))
    got = sorted(map(tuple, boxes.box_join(left, right).select("l_id", "r_id").collect()))
    want = sorted((a[0], b[0]) for a in sets[0] for b in sets[1] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want
    assert boxes.box_join(left.limit(0), right).count() == 0


def test_one_giant_among_small_polygons(spark):
    """Rows stay linear: four for the giant, a host and a guest row for each small one."""
    n = 120
    small = spark.range(n * n).select("id", (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    lots = small.select("id", F.array(F.array(corner(0.1, 0.1), corner(0.9, 0.1), corner(0.9, 0.9), corner(0.1, 0.9))).alias("parts"))
    giant = shaped(spark, [rect(-1, 40.5, 50.5, 1e5, 60.5), rect(-2, -1e9, -1e9, -1e8, -1e8)])
    both = lots.unionByName(giant)
    dealt = boxes.boxed(both.select("id", "parts"), F.flatten("parts"), "l_")
    own = dealt.withColumn("_own", boxes._level("l_", -20))
    assert boxes._dealt(own, "l_", F.col("_own")).count() <= 4 * (n * n + 2)
    hit = shapes.candidates(giant, both).filter("l_id <> r_id")
    assert hit.count() == (n - 40) * 11  # lots 40 to 119 of rows 50 to 60
    assert polygons.points_in_polygons(small, giant).count() == (n - 41) * 10


def test_nearest_with_a_far_point(spark):
    """A sentinel at 1e9 among degrees: cells stay as fine as the points are close, and the answers are right."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(0, 1, (600, 2)), [(1e9, 1e9)]])
    frame = points(spark, xy)
    got = {}
    for r in joins.knn_join(frame, 3).collect():
        got.setdefault(r["focal"], []).append((r["distance"], r["neighbor"]))
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all([k for _, k in sorted(got[i])] == want[i].tolist() for i in range(600))
    assert [k for _, k in sorted(got[600])] == want[600].tolist()
