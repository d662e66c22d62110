"""Regions against identities of areas, joins and triangulations against brute force, matrices, tables, graph exchange."""

from __future__ import annotations

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.functions import geometry as geo
from edgeloom.functions import regions
from edgeloom.operators import builders, joins, matching, shapes, triangulation, weights
from edgeloom.operators.graph import Graph, numbered
from edgeloom.sources import binary, matrices, tables, weights_text


def points(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")


def pairs(g):
    return {(r["focal"], r["neighbor"]) for r in g.links().collect()}


def square(x, y, w=1.0, h=None):
    h = w if h is None else h
    return [np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)]


def table(spark, *polygons):
    return spark.createDataFrame([(k, regions.parts_of(p)) for k, p in enumerate(polygons)], f"id long, parts {shapes.PARTS}")


def size(rings):
    return sum(regions.area(r) for r in rings)


def test_overlay_areas_add_up():
    rng = np.random.default_rng(0)
    for _ in range(150):
        a, b = ([np.stack([c[0] + r * np.cos(t), c[1] + r * np.sin(t)], 1)] for c, r, t in ((rng.random(2) * s, 0.5 + rng.random(9), np.linspace(0, 2 * np.pi, 10)[:-1] + rng.random(9) * 0.5) for s in (0, 1)))
        both, either, rest, apart = (size(regions.overlay(a, b, how)) for how in ("intersection", "union", "difference", "symmetric_difference"))
        x, y = size(a), size(b)
        assert both + either == pytest.approx(x + y) and rest == pytest.approx(x - both) and apart == pytest.approx(x + y - 2 * both)


def test_relations_and_holes():
    outer, inner = square(0, 0, 4), square(1, 1)
    ring = regions.overlay(outer, inner, "difference")
    assert len(ring) == 2 and size(ring) == pytest.approx(15) and size(regions.overlay(ring, inner, "union")) == pytest.approx(16)
    say = lambda a, b: {k for k, v in regions.relations(a, b).items() if v}
    assert say(outer, inner) == {"intersects", "contains"} and say(inner, outer) == {"intersects", "within"}
    assert say(ring, inner) == {"intersects", "touches"} and say(square(0, 0), square(1, 1)) == {"intersects", "touches"}
    assert say(square(0, 0), square(0, 0)) == {"intersects", "equals", "within", "contains"} and say(square(0, 0), square(5, 5)) == {"disjoint"}
    assert say(square(0, 0, 2), square(1, 1, 2)) == {"intersects", "overlaps"} and say(square(0, 0, 2), square(1, 0)) == {"intersects", "contains"}
    assert regions.distance(square(0, 0), square(4, 5)) == 5 and regions.distance(outer, inner) == 0 and regions.distance([], inner) == math.inf
    assert size(regions.buffered(square(0, 0), 1)) == pytest.approx(5 + math.pi, abs=0.02)
    assert regions.is_simple(square(0, 0)[0]) and not regions.is_simple(np.array([[0, 0], [1, 1], [1, 0], [0, 1]], float))
    assert regions.overlay([], inner, "union")[0].shape == (4, 2) and regions.overlay(inner, [], "intersection") == []


def test_polygon_tables(spark):
    a, b = table(spark, square(0, 0, 2), square(5, 5)), table(spark, square(1, 1, 2), square(0, 0), square(9, 9))
    assert {tuple(r) for r in shapes.spatial_join(a, b, "left").collect()} == {(0, 0), (0, 1), (1, None)}
    assert {tuple(r) for r in shapes.spatial_join(a, b, "right", "contains").collect()} == {(None, 0), (0, 1), (None, 2)}
    with pytest.raises(ValueError):
        shapes.spatial_join(a, b, predicate="near")
    area = lambda how: shapes.overlay(a, b, how).select(F.sum(shapes.polygon_area(F.col("parts")))).first()[0]
    assert [area(h) for h in ("intersection", "difference", "identity", "union", "symmetric_difference")] == pytest.approx([2, 3, 5, 5 + 4, 3 + 4])
    grid = builders.lattice_polygons(spark, 5, 5).filter("id <> 12").withColumn("g", (F.col("id") >= 0).cast("int"))
    whole = shapes.dissolve(grid, "g").select("group", shapes.polygon_area(F.col("parts")).alias("a"), F.size("parts").alias("n")).collect()
    assert [tuple(r) for r in whole] == [(1, 24.0, 2)]
    assert shapes.union(table(spark)).count() == 0 and shapes.intersection(a).select(F.size("parts")).first()[0] == 0
    one = table(spark, [np.array([[0, 0], [1, 0.001], [2, 0], [2, 2], [0, 2]], float)], [np.array([[0, 0], [1, 1], [1, 0], [0, 1]], float)])
    got = one.select(shapes.is_valid(F.col("parts")).alias("v"), F.size(shapes.simplify(F.col("parts"), 0.1)[0]).alias("n"), F.size(shapes.hull_of(F.col("parts"))[0]).alias("h"), shapes.is_empty(F.col("parts")).alias("e"), shapes.is_ring(shapes.boundary(F.col("parts"))[0]).alias("r")).collect()
    assert (got[0]["v"], got[0]["n"], got[0]["h"], got[0]["e"], got[0]["r"]) == (True, 4, 4, False, True) and not got[1]["v"] and not got[1]["r"]
    assert shapes.validate(a) == "polygon"
    for bad in (a.drop("id"), a.unionByName(a), points(spark, [(0, 0)]).withColumn("x", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            shapes.validate(bad)


def test_fuzzy_and_nonplanar(spark):
    t = table(spark, square(0, 0), square(1.3, 0), square(10, 10, 2), square(10.5, 10.5))
    assert pairs(shapes.fuzzy_contiguity(t)) == {(2, 3), (3, 2)} and pairs(shapes.fuzzy_contiguity(t, 0.2)) == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert pairs(shapes.fuzzy_contiguity(t, predicate="contains")) == {(2, 3)} and pairs(shapes.fuzzy_contiguity(t, 0.2, predicate="overlaps")) == {(0, 1), (1, 0)}
    with pytest.raises(ValueError):
        shapes.fuzzy_contiguity(t, 1.0, 0.1)
    none = Graph(spark.createDataFrame([], "focal long, neighbor long, weight double"), t.select("id"))
    g, new = shapes.nonplanar_neighbors(none, t, 0.03)
    assert pairs(g) == {(0, 1), (1, 0), (2, 3), (3, 2)} and new.count() == 4


def test_nearest_joins(spark):
    rng = np.random.default_rng(2)
    cloud = np.vstack([rng.random((150, 2)), 1e-4 * rng.random((60, 2)) + 0.3, np.full((40, 2), 0.7), [[1e6, -1e6]]])
    left, right = points(spark, cloud), points(spark, np.vstack([rng.random((80, 2)), np.full((30, 2), 0.7)]))
    xy, other = cloud, np.array([[r["x"], r["y"]] for r in right.orderBy("id").collect()])
    for p in (1, 2, math.inf):
        d = np.linalg.norm(xy[:, None] - other[None], ord=p, axis=2)
        want = {(i, int(j)) for i in range(len(xy)) for j in np.lexsort((np.arange(len(other)), d[i]))[:4]}
        got = joins.nearest_join(left, right, 4, p=p)
        assert {(r["focal"], r["neighbor"]) for r in got.collect()} == want
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(xy)) for j in np.lexsort((np.arange(len(xy)), d[i]))[:3]}
    assert {(r["focal"], r["neighbor"]) for r in joins.knn_join(left, 3).collect()} == want
    few = points(spark, [(0, 0), (1, 0)])
    assert joins.nearest_join(few, few.limit(1), 5).count() == 2 and joins.knn_join(few.limit(1), 3).count() == 0 and joins.nearest_join(few, few.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        joins.knn_join(few, 0)
    ends = rng.random((40, 4))
    pt = lambda x, y: {"x": float(x), "y": float(y)}
    seg = spark.createDataFrame([(k, pt(e[0], e[1]), pt(e[2], e[3])) for k, e in enumerate(ends)], "id long, p struct<x:double,y:double>, q struct<x:double,y:double>")
    far = points(spark, [*cloud[:40], (30.0, 40.0)])
    sides = ends.reshape(-1, 2, 2)
    gaps = regions._point_gaps(np.array([*cloud[:40], (30.0, 40.0)]), sides)
    assert {r["id"]: r["segment_id"] for r in joins.segment_nearest_join(far, seg).collect()} == {k: int(row.argmin()) for k, row in enumerate(gaps)}


def test_metrics_bandwidths_and_coplanar_points(spark):
    xy = [(0, 0), (0, 0), (1, 0), (2, 0), (5, 0)]
    p = points(spark, xy)
    with pytest.raises(ValueError):
        builders.knn(p, 1, coplanar="raise")
    with pytest.raises(ValueError):
        builders.knn(p, 1, metric="jaccard")
    moved = builders.jitter(p, 5)
    same = [tuple(r) for r in moved.orderBy("id").collect()]
    assert same == [tuple(r) for r in builders.jitter(p, 5).orderBy("id").collect()] and same[2:] == [tuple(r) for r in p.orderBy("id").collect()][2:]
    assert moved.select("x", "y").distinct().count() == 5 and builders.knn(p, 2, coplanar="jitter").edges.count() == 10
    lonlat = p.select("id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    assert pairs(builders.knn(lonlat.filter("id > 0"), 1, metric="haversine")) == {(1, 2), (2, 1), (3, 2), (4, 3)}
    rows = spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).integers(0, 50, 3000)], "v double")
    v = np.array([r["v"] for r in rows.collect()])
    for q in (0.0, 0.25, 0.5, 0.77, 1.0):
        for most in (10, 100_000):
            assert builders.quantile(rows, "v", q, 16, most) == pytest.approx(np.quantile(v, q))
    assert builders.quantile(rows.limit(0), "v", 0.5) is None
    near = builders.all_pairs(points(spark, np.random.default_rng(1).random((40, 2))))
    h = builders.optimal_bandwidth(near, "triangular", 40)
    d = np.array([r["distance"] for r in near.collect()])

    def spread(b):
        c = np.histogram(1 - np.clip(d / b, 0, 1), bins=6, range=(0, 1))[0]
        c = c[c > 0] / c.sum()
        return -(c * np.log(c)).sum()

    assert 0 < h <= 2 * d.max() and spread(h) > max(spread(0.3 * h), spread(2.5 * h))
    assert builders.kernel(points(spark, [(0, 0), (1, 0), (3, 0)]), "triangular", bandwidth="auto").edges.count() == 6
    for method in ("delaunay", "gabriel", "relative_neighborhood"):
        spread_out = points(spark, [*np.random.default_rng(4).random((20, 2)), (0.5, 0.5), (0.5, 0.5)])
        g = triangulation.triangulation(spread_out, method, coplanar="clique")
        assert (20, 21) in pairs(g) and (21, 20) in pairs(g)
        with pytest.raises(ValueError):
            triangulation.triangulation(spread_out, method, coplanar="raise")
    more = builders.reweight(builders.knn(p.filter("id > 0"), 1), p.filter("id > 0"), 2, points(spark, [(9, 9)]).withColumn("id", F.lit(99).cast("bigint")))
    assert more.nodes.count() == 5 and more.links().filter("focal = 99").count() == 2


def test_triangulation_sweep():
    rng = np.random.default_rng(3)
    for n in (3, 60, 2500):
        xy = rng.random((n, 2))
        tri = triangulation.delaunay_triangles(xy)
        a, b, c = (xy[tri[:, k]] for k in range(3))
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
        if n > 3:
            assert area == pytest.approx(size([_hull(xy)]), rel=1e-2)
        for t in tri[:: max(1, len(tri) // 200)]:
            p = xy[t]
            m = np.linalg.solve(2 * (p[1:] - p[0]), (p[1:] ** 2).sum(1) - (p[0] ** 2).sum())
            assert (((xy - m) ** 2).sum(1) > ((p[0] - m) ** 2).sum() * (1 - 1e-9)).all()


def _hull(xy):
    pts = xy[np.lexsort((xy[:, 1], xy[:, 0]))]
    half = []
    for line in (pts, pts[::-1]):
        out: list = []
        for p in line:
            while len(out) > 1 and regions._cross(out[-1] - out[-2], p - out[-2]) <= 0:
                out.pop()
            out.append(p)
        half += out[:-1]
    return np.array(half)


def test_voronoi_and_alpha(spark):
    grid = builders.lattice_polygons(spark, 5, 5).select("id", F.col("parts")[0][0]["x"].alias("x"), F.col("parts")[0][0]["y"].alias("y"))
    rook = pairs(builders.lattice(spark, 5, 5))
    for clip in ("bounding_box", "convex_hull", None, table(spark, square(-1, -1, 9))):
        assert pairs(shapes.voronoi_contiguity(grid, clip=clip, margin=0.5)) == rook
    assert rook < pairs(shapes.voronoi_contiguity(grid, rook=False))
    with pytest.raises(ValueError):
        shapes.voronoi_frames(grid, "circle")
    cloud = points(spark, np.random.default_rng(8).random((40, 2)))
    tight = shapes.voronoi_frames(cloud, "alpha_shape").select(F.sum(shapes.polygon_area(F.col("parts")))).first()[0]
    box = shapes.voronoi_frames(cloud).select(F.sum(shapes.polygon_area(F.col("parts")))).first()[0]
    radius = triangulation.alpha_auto(cloud).first()["radius"]
    shape = triangulation.alpha_polygons(cloud, 1 / (radius * (1 + 1e-9))).collect()
    assert len(shape) == 1 and tight == pytest.approx(shape[0]["area"], rel=1e-6) and tight < box


def test_matching(spark):
    rng = np.random.default_rng(6)
    xy = rng.random((8, 2))
    g = matching.matches_within(points(spark, xy))
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)

    def best(left):
        if not left:
            return 0.0
        i, rest = left[0], left[1:]
        return min(d[i, j] + best([k for k in rest if k != j]) for j in rest)

    total = sum(d[i, j] for i, j in pairs(g)) / 2
    assert total == pytest.approx(best(list(range(8)))) and g.cardinalities().filter("cardinality <> 1").isEmpty()
    odd = points(spark, [(0, 0), (1, 0), (0.5, 0.8)])
    with pytest.raises(ValueError):
        matching.matches_within(odd)
    half = matching.matches_within(odd, partial=True)
    assert {r["weight"] for r in half.links().collect()} == {0.5} and half.links().count() == 6


class Net:
    """A stand-in with the interface of a networkx graph."""

    def __init__(self, nodes, edges, directed):
        self.nodes, self._edges, self._directed = nodes, edges, directed

    def edges(self, data=True):
        return self._edges

    def is_directed(self):
        return self._directed


def test_graph_exchange(spark):
    g = Graph.from_networkx(spark, Net(["a", "b", "c", "d"], [("a", "b", {"weight": 2}), ("c", "c", {"weight": 1})], False))
    assert pairs(g) == {("a", "b"), ("b", "a"), ("c", "c")} and [r["id"] for r in g.isolates().collect()] == ["d"]
    assert pairs(Graph.from_networkx(spark, Net([0, 1], [(0, 1, {})], True), None)) == {(0, 1)}
    with pytest.raises(ValueError):
        Graph.from_networkx(spark, Net([0, 1], [(0, 1, {})], True))
    data = g.node_link()
    assert not data["directed"] and [n["id"] for n in data["nodes"]] == ["a", "b", "c", "d"] and len(data["links"]) == 3
    assert len(g) == 3 and g == g.transform("O") and g != g.transform("B") and bool(g)
    text = g.report()
    assert "nodes" in text and "trace_gtg_gg" in text
    at = spark.createDataFrame([(i, float(k), 0.0) for k, i in enumerate("abcd")], "id string, x double, y double")
    assert g.plot(at).count("<line") == 3 and g.plot(at, "a", nodes=False).count("<line") == 1 and g.edge_lines(at, "a").count() == 1
    with pytest.raises(ValueError):
        g.plot(at, most=1)
    two = Graph.from_dicts(spark, {1: [2], 2: [3], 3: [1], 4: [5], 5: [6], 6: [4]})
    six = Graph.from_dicts(spark, {1: [2], 2: [3], 3: [4], 4: [5], 5: [6], 6: [1]})
    assert not two.isomorphic(six) and six.isomorphic(six.remap(spark.createDataFrame([(k, (k * 5) % 7) for k in range(1, 7)], "id long, new_id long")))
    y = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(1, 7)], "id long, y string")
    ring = six.make_symmetric()
    assert ring.lag(y, ties="random", seed=1).exceptAll(ring.lag(y, ties="random", seed=1)).isEmpty()
    with pytest.raises(ValueError):
        ring.lag(y, ties="first")
    assert [tuple(r) for r in numbered(y.repartition(5)).orderBy("id").collect()] == [(k, k - 1) for k in range(1, 7)]
    w = weights.Weights(six)
    assert dict(iter(w))[6] == {1: 1.0} and w[1] == {2: 1.0} and w.set_shapefile("/x/lots.shp").source["name"] == "lots"
    tie = weights.Weights(ring).lag_categorical(y.withColumn("z", F.col("y")), ("y", "z"), "lowest")
    assert tie.columns == ["id", "lag_y", "lag_z"] and tie.count() == 6
    apart = weights.adjlist_map(six.edges, y.withColumn("v", F.col("id").cast("double")), {"gap": (lambda a, b: b - a, ("v",))})
    assert {r["gap"] for r in apart.collect()} == {1.0, -5.0}
    bad = spark.createDataFrame([(0, 9, 1.0)], "i long, j long, w double")
    with pytest.raises(ValueError):
        weights.SparseWeights(bad, weights.Weights(six).places())


def test_rasters(spark):
    r = builders.test_raster(spark)
    builders.check_raster(r)
    for wrong in (r.unionByName(r), r.withColumn("value", F.lit("x")), r.withColumn("row", F.col("row") + 0.5)):
        with pytest.raises(ValueError):
            builders.check_raster(wrong)
    cells = builders.raster_cells(r, 1, -32768.0)
    assert cells.count() == r.filter("layer = 1 AND value <> -32768").count() and builders.test_raster(spark, missing=False).filter("value < 0").isEmpty()
    line = spark.createDataFrame([(0, 0, 0), (2, 0, 2)], "id long, row int, col int")
    gap = spark.createDataFrame([(0, 1)], "row int, col int")
    assert pairs(builders.raster_contiguity(line, True, 2)) == set() and pairs(builders.raster_contiguity(line, True, 2, gap)) == {(0, 2), (2, 0)}
    g = builders.raster_contiguity(cells)
    grid = g.to_grid(cells, cells.select("id", F.col("value").alias("y")), -1.0)
    assert grid.filter("value <> -1").count() == cells.count()


def test_matrix_files(spark, tmp_path):
    g = Graph.from_dicts(spark, {0: [1, 2], 1: [0], 2: [1], 3: []}, {0: [0.5, 2.0], 1: [1.0], 2: [3.0], 3: []})
    rows = lambda x: sorted(tuple(r) for r in x.edges.collect())
    for sparse in (False, True):
        matrices.write_mat(g, f"{tmp_path}/w{sparse}.mat", sparse)
        assert rows(matrices.read_mat(spark, f"{tmp_path}/w{sparse}.mat")) == rows(g)
    matrices.write_wk1(g, f"{tmp_path}/w.wk1")
    assert rows(tables.read(spark, f"{tmp_path}/w.wk1")) == rows(g)
    full = np.zeros((4, 4))
    full[0, 1], full[0, 2], full[1, 0], full[2, 1] = 0.5, 2, 1, 3
    (tmp_path / "old.mat").write_bytes(struct.pack("<5I", 0, 4, 4, 0, 2) + b"W\0" + full.tobytes(order="F"))
    cells = np.array([[1, 2, 0.5], [1, 3, 2], [2, 1, 1], [3, 2, 3], [4, 4, 0]])
    (tmp_path / "olds.mat").write_bytes(struct.pack("<5I", 2, 5, 3, 0, 2) + b"W\0" + cells.tobytes(order="F"))
    for name in ("old", "olds"):
        assert rows(matrices.read_mat(spark, f"{tmp_path}/{name}.mat")) == rows(g)
    (tmp_path / "bad.wk1").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        matrices.wk1_cells(b"nothing")
    with pytest.raises(ValueError):
        matrices.write_wk1(builders.lattice(spark, 17, 17), f"{tmp_path}/x.wk1")


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,v\n1,"a, b",2.5\n2,c,x\n')
    t = tables.read(spark, f"{tmp_path}/t.csv", types={"v": "double"})
    assert dict(t.dtypes) == {"id": "int", "name": "string", "v": "double"} and [tuple(r) for r in t.orderBy("id").collect()] == [(1, "a, b", 2.5), (2, "c", None)]
    assert tables.read(spark, f"{tmp_path}/t.csv", n=1).count() == 1 and tables.by_column(t, "v").columns == ["v"]
    with pytest.raises(KeyError):
        tables.by_column(t, "w")
    with pytest.raises(ValueError):
        tables.form_of("x.docx")
    with sqlite3.connect(f"{tmp_path}/d.db") as con:
        con.execute("CREATE TABLE lots (id INTEGER, v REAL, g TEXT)")
        con.executemany("INSERT INTO lots VALUES (?, ?, ?)", [(1, 0.5, '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}'), (2, None, '{"type":"Point","coordinates":[3,4]}')])
    got = {r["id"]: r for r in tables.read_sql(spark, f"sqlite:///{tmp_path}/d.db", "lots", geometry="g").collect()}
    assert len(got[1]["parts"][0]) == 3 and got[2]["parts"][0][0]["y"] == 4 and got[1]["v"] == 0.5
    for url, name in (("sqlite:///" + f"{tmp_path}/d.db", "none"), ("mongo://x", "lots")):
        with pytest.raises(ValueError):
            tables.read_sql(spark, url, name)
    noted = tables.with_metadata(t, "v", unit="m", bounds=[1, 2])
    assert noted.schema["v"].metadata == {"unit": "m", "bounds": "[1, 2]"}
    with pytest.raises(ValueError):
        tables.with_metadata(noted, "v", unit="km")
    assert tables.with_metadata(noted, "v", True, unit="km").schema["v"].metadata["unit"] == "km"
    known = tables.Examples()
    known.add("t", f"{tmp_path}/t.csv", "two rows")
    known.add("ring", lambda s: builders.lattice(s, 2, 2))
    assert known.available() == ["ring", "t"] and known.explain("t") == "two rows" and known.load(spark, "t").count() == 2 and known.load(spark, "ring").nodes.count() == 4
    with pytest.raises(KeyError):
        known.load(spark, "u")
    sq = builders.lattice_polygons(spark, 3, 3).select(F.col("id").alias("record"), F.lit("polygon").alias("kind"), "parts", (F.col("id") * 2).alias("KEY"))
    binary.write_table(sq, f"{tmp_path}/sq")
    assert [tuple(r) for r in binary.read_shx(spark, f"{tmp_path}/sq.shx").orderBy("record").limit(2).collect()] == [(0, 100, 128), (1, 236, 128)]
    assert binary.min_threshold_of(spark, f"{tmp_path}/sq.shp").first()[0] == pytest.approx(1.0) and binary.ids_of(spark, f"{tmp_path}/sq", "KEY").count() == 9
    weights_text.write_grid_gal(spark, f"{tmp_path}/g.gal", 3)
    assert pairs(tables.read(spark, f"{tmp_path}/g.gal")) == pairs(builders.lattice(spark, 3, 3))
    texts = ['{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}', '{"type":"LineString","coordinates":[[0,0],[3,4]]}', "none"]
    parts = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(geo.from_geojson(F.col("t"))).collect()]
    assert [len(p) for p in parts[:2]] == [2, 1] and len(parts[0][0]) == 3 and parts[2] is None


def test_scratch_tables_go(spark):
    before = scratch.tables()
    df, path = scratch.write(spark.range(3))
    assert path in scratch.tables() and df.count() == 3
    scratch.release(spark, before)
    assert scratch.tables() == before
    with pytest.raises(Exception, match="(?i)not exist|not found|PATH_NOT_FOUND|FAILED_READ_FILE"):
        spark.read.schema("id long").parquet(path).count()
