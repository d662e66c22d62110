"""Golden values of small graphs, invariants, formats, and the query catalogue against DuckDB."""

from __future__ import annotations

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import geometry as geo
from edgeloom.functions import sphere
from edgeloom.functions.kernels import KERNELS, kernel
from edgeloom.operators import builders, matching, polygons, triangulation, weights
from edgeloom.operators.graph import Graph
from edgeloom.operators.joins import band_join, knn_join
from edgeloom.plans import queries
from edgeloom.sources import binary, weights_text
from edgeloom.streaming.windows import windowed_lag

SF = "/root/testdata/sf0.001"
W10 = {0: {0: 1, 3: 0.5, 1: 0.5}, 1: {0: 0.3, 4: 0.3, 2: 0.3}, 2: {1: 0.5, 5: 0.5}, 3: {0: 0.3, 6: 0.3, 4: 0.3}, 4: {1: 0.25, 3: 0.25, 7: 0.25, 5: 0.25}, 5: {2: 0.3, 4: 0.3, 8: 0.3}, 6: {3: 0.5, 7: 0.5}, 7: {4: 0.3, 6: 0.3, 8: 0.3}, 8: {5: 0.5, 7: 0.5}, 9: {}}


@pytest.fixture(scope="module")
def w10(spark):
    return Graph.from_weights_dict(spark, W10)


def values(df, key="id", value=None):
    return {r[key]: r[value or df.columns[-1]] for r in df.collect()}


def pairs(g):
    return {(r["focal"], r["neighbor"]) for r in g.links().collect()}


def points(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")


@pytest.mark.parametrize("name", list(queries.sql()))
def test_catalogue(spark, name):
    plan, sql = queries.queries()[name], queries.sql()[name]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = plan(spark, SF), con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_golden_graph(spark, w10):
    y = spark.createDataFrame([(k, float(k + 1)) for k in range(10)], "id long, y double")
    assert [round(values(w10.lag(y))[k], 6) for k in range(10)] == [4, 2.7, 4, 3.9, 5, 5.1, 6, 6.3, 7, 0]
    assert [values(w10.cardinalities())[k] for k in range(10)] == [3, 3, 2, 3, 4, 3, 2, 3, 2, 0]
    p = w10.properties().first()
    assert (p["n"], p["n_edges"], p["pct_nonzero"], p["n_isolates"]) == (10, 25, 26.0, 1)
    assert {r["s"] for r in w10.transform("R").edges.filter("focal <> 9").groupBy("focal").agg(F.round(F.sum("weight"), 9).alias("s")).collect()} == {1.0}
    assert math.isclose(w10.transform("D").edges.agg(F.sum("weight")).first()[0], 1.0)
    assert math.isclose(w10.transform("V").edges.agg(F.sum("weight")).first()[0], 10.0)
    assert values(w10.isolates()) == {9: 9}
    assert w10.validate() is w10


def test_block_graph(spark):
    r = spark.createDataFrame([(k, "abc"[k % 3] if k < 9 else ("d" if k == 9 else None)) for k in range(11)], "id long, regime string")
    y = spark.createDataFrame([(k, float(k * k) if k != 4 else None) for k in range(11)], "id long, y double")
    g = builders.block_contiguity(r)
    for kind in ("B", "R"):
        plain = Graph(Graph(g.edges, r).transform(kind).edges, r)
        assert values(g.transform(kind).lag(y)) == pytest.approx({k: v or 0.0 for k, v in values(plain.lag(y)).items()})
        assert values(g.transform(kind).cardinalities()) == values(plain.cardinalities())
        assert g.transform(kind).edges.count() == 20 and math.isclose(g.transform("R").edges.agg(F.sum("weight")).first()[0], 9.0)
    assert g.transform("D").edges.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_modal_lag(spark):
    g = builders.lattice(spark, 3, 3)
    y = spark.createDataFrame(list(enumerate("ababcbcbc")), "id long, y string")
    assert "".join(values(g.lag(y, ties="lowest"))[k] for k in range(9)) == "babcbcbcb"
    v = spark.createDataFrame([(k, float(k)) for k in range(9)], "id long, y double")
    assert [values(g.lag(v))[k] for k in range(9)] == [4, 6, 6, 10, 16, 14, 10, 18, 12]
    with pytest.raises(Exception, match="ties"):
        Graph.from_dicts(spark, {0: [1, 2], 1: [0], 2: [0]}).lag(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, y string")).collect()
    h = Graph.from_dicts(spark, {"a": ["b"], "b": ["c", "a"], "c": ["b"], "d": []})
    assert [values(h.lag(spark.createDataFrame(list(zip("abcd", [0.0, 1.0, 2.0, 3.0])), "id string, y double")))[k] for k in "abcd"] == [1, 2, 1, 0]


def test_summary(spark):
    g = Graph.from_dicts(spark, {0: [], 1: [2, 3, 4], 2: [1, 3], 3: [1, 2, 4], 4: [1, 3]})
    s = g.summary().first()
    assert (s["s0"], s["s1"], s["s2"], s["trace_gg"], s["trace_gtg"], s["trace_gtg_gg"]) == (10, 20, 104, 10, 10, 20)
    assert [values(g.diagonals(), value="diag_gg")[k] for k in range(5)] == [0, 3, 2, 3, 2]
    assert g.n_components().first()[0] == 2
    d = g.distribution().filter("what = 'cardinality'").first()
    assert (d["mean"], round(d["std"], 4), d["p25"], d["p50"], d["p75"]) == (2, 1.2247, 2, 2, 3)
    assert values(builders.lattice(spark, 3, 3, "queen").local_clustering())[4] == pytest.approx(0.42857143)


def test_symmetry(spark):
    a = Graph.from_weights_dict(spark, {"a": {"b": 1, "c": 0.5, "d": 1}, "b": {"b": 1, "c": 1, "d": 1}, "c": {"a": 1, "b": 1}, "d": {"a": 1, "b": 1}})
    got = lambda g, **k: {(r["focal"], r["neighbor"]) for r in g.asymmetry(**k).collect()}
    assert got(a) == {("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")} and got(a, intrinsic=False) == {("a", "b"), ("b", "a")}
    with pytest.raises(Exception, match="reduction"):
        a.make_symmetric().edges.collect()
    s = [a.make_symmetric(reduction=r).edges.agg(F.sum("weight")).first()[0] for r in ("min", "mean", "max", "sum")]
    assert s == sorted(s) and got(a.make_symmetric(reduction="sum")) == set()
    assert len(pairs(a.make_symmetric(intersection=True, reduction="sum"))) < len(pairs(a.make_symmetric(reduction="sum")))


def test_higher_order(spark):
    g = Graph.from_dicts(spark, {0: [], 1: [3], 2: [4], 3: [1, 4], 4: [2, 3]})
    assert len(pairs(g.higher_order(2, lower_order=True))) == 10
    assert pairs(g.higher_order(2)).isdisjoint(pairs(g))
    ring = Graph.from_dicts(spark, {k: [(k + 1) % 40, (k - 1) % 40] for k in range(40)} | {100: []})
    assert set(values(ring.component_labels()).values()) == {0, 100}
    assert ring.shimbel().agg(F.max("hops")).first()[0] == 20


def test_sets(spark):
    rook, queen = builders.lattice(spark, 4, 4), builders.lattice(spark, 4, 4, "queen")
    assert pairs(queen - rook) == pairs(builders.lattice(spark, 4, 4, "bishop"))
    assert pairs(queen ^ rook) == (pairs(queen) | pairs(rook)) - (pairs(queen) & pairs(rook))
    assert rook <= queen and rook < queen and queen > rook and not rook >= queen and rook.intersects(queen) and rook.equals(rook & queen)
    tall = builders.lattice(spark, 6, 4)
    assert {j for i, j in pairs(weights.union(rook, tall)) if i == 15} == {11, 14, 19}
    with pytest.raises(ValueError):
        rook.union(tall)
    assert {j for i, j in pairs(weights.symmetric_difference(queen, tall)) if i == 15} == {10, 19}
    assert weights.neighbor_equality(rook, rook & queen)
    assert weights.intersection(rook, tall, "min").nodes.count() == 16 and weights.difference(tall, rook, "min").nodes.count() <= 24


def test_legacy_surface(spark, w10):
    w = weights.Weights(w10)
    w.transform = "r"
    w.transform = "b"
    assert w.graph.edges.agg(F.max("weight")).first()[0] == 1.0
    w.transform = "o"
    assert w.graph.equals(w10) and w.properties().first()["nonzero"] == 25
    a = weights.Weights.from_adjlist(spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "focal long, neighbor long"))
    assert pairs(a.symmetrize().graph) == {(0, 1), (1, 0), (1, 2), (2, 1)} and a.to_adjlist(True).count() == 2
    y = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, y string")
    assert values(a.symmetrize().lag_categorical(y))[1] == "a" and values(a.symmetrize().lag_categorical(y, ties="highest"))[1] == "c"
    assert a.symmetrize().neighbor_offsets().count() == 3
    assert weights.adjlist_apply(a.to_adjlist(), y.withColumn("y", F.col("id")), lambda p, q: p - q, "y").agg(F.sum("y_apply")).first()[0] == -2


def test_kernels(spark):
    row = spark.range(1).select(*[kernel(F.lit(0.5), 1.0, k).alias(k) for k in KERNELS]).first()
    want = {"triangular": 0.5, "parabolic": 0.5625, "gaussian": math.exp(-0.125) / math.sqrt(2 * math.pi), "bisquare": 15 / 16 * 0.75**2, "tricube": 70 / 81 * 0.875**3, "cosine": math.pi / 4 * math.cos(math.pi / 4), "exponential": math.exp(-0.5), "boxcar": 1, "identity": 0.5, "epanechnikov": 0.5625, "uniform": 1}
    assert all(row[k] == pytest.approx(v) for k, v in want.items())
    p6 = points(spark, [(10, 10), (20, 10), (40, 10), (15, 20), (30, 20), (30, 30)])
    g = builders.adaptive_kernel(p6, 2, "gaussian")
    w0 = sorted((r["weight"] for r in g[0].collect()), reverse=True)
    assert w0 == pytest.approx([0.398942, 0.267419, 0.241971], abs=1e-6)
    assert pairs(builders.knn(p6, 2)) >= {(0, 1), (0, 3)}
    grid = points(spark, [(i, j) for i in range(10) for j in range(10)])
    assert builders.kernel(grid, "boxcar", k=3, bandwidth=0.5).isolates().count() == 100
    with pytest.raises(ValueError):
        kernel(F.lit(1.0), 1.0, "none")


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(0, 0.001, (50, 2)), rng.uniform(-500, 500, (20, 2)), [[3, 3], [3, 3]]])
    p = points(spark, xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    got = {(r["focal"], r["neighbor"]) for r in band_join(p, p, 0.7).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 0.7))))
    np.fill_diagonal(d, np.inf)
    near = {i: {r["neighbor"] for r in rows} for i, rows in _by_focal(knn_join(p, 5)).items()}
    assert near == {i: set(np.lexsort((np.arange(len(xy)), d[i]))[:5].tolist()) for i in range(len(xy))}
    assert knn_join(p, 1).agg(F.max("distance")).first()[0] == pytest.approx(d.min(1).max())
    clique = builders.knn(points(spark, [(0, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]), 2, coplanar="clique")
    assert {j for i, j in pairs(clique) if i == 0} - {1} == {j for i, j in pairs(clique) if i == 1} - {0}


def _by_focal(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["focal"], []).append(r)
    return out


def test_triangulation(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 1, (60, 2))
    t = triangulation.delaunay_triangles(xy)
    for a, b, c in t:  # empty circumcircles
        m = np.array([xy[b] - xy[a], xy[c] - xy[a]])
        o = xy[a] + np.linalg.solve(2 * m, (m**2).sum(1))
        r = np.linalg.norm(o - xy[a])
        assert (np.linalg.norm(xy - o, axis=1) >= r - 1e-9).all()
    p = points(spark, xy)
    dl, gb, rn = (pairs(triangulation.triangulation(p, m)) for m in ("delaunay", "gabriel", "relative_neighborhood"))
    assert rn <= gb <= dl and {(j, i) for i, j in dl} == dl and len(dl) == 2 * (3 * 60 - 3 - triangulation.convex_hull(p).count())
    tight = triangulation.alpha_auto(p).collect()
    degree = np.bincount([i for r in tight for i in (r["a"], r["b"])], minlength=60)
    assert (degree % 2 == 0).all() and len(tight) >= triangulation.convex_hull(p).count() and tight[0]["radius"] > 0
    assert triangulation.alpha_faces(p, 1e-6).count() == triangulation.convex_hull(p).count()


def test_matching(spark):
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(20):
        c = rng.uniform(0, 1, (4, 6))
        got = matching.assign(c)
        assert len(set(got)) == 4 and c[range(4), got].sum() == pytest.approx(min(c[range(4), p].sum() for p in permutations(range(6), 4)))
    a = points(spark, rng.uniform(0, 1, (3, 2)))
    b = points(spark, rng.uniform(0, 1, (8, 2))).withColumn("id", F.col("id") + 100)
    g = matching.spatial_matches(a, b, k=2)
    assert len(pairs(g)) == 6 and len({j for _, j in pairs(g)}) == 6
    with pytest.raises(ValueError):
        matching.spatial_matches(b, a)


def test_polygons(spark):
    sq = lambda x, y, w, h: [[{"x": float(p), "y": float(q)} for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]
    df = spark.createDataFrame([(0, sq(0, 0, 2, 2)), (1, sq(2, 0.5, 1, 1)), (2, sq(2, 2, 1, 1)), (3, sq(9, 9, 1, 1))], "id long, parts array<array<struct<x:double,y:double>>>")
    assert pairs(polygons.strict_contiguity(df)) == {(0, 1), (1, 0)} and pairs(builders.contiguity(df, rook=False)) == {(0, 2), (2, 0)}
    assert pairs(polygons.strict_contiguity(df, rook=False)) == {(0, 1), (1, 0), (0, 2), (2, 0)}
    assert {r["weight"] for r in polygons.strict_contiguity(df, by_perimeter=True).links().collect()} == {1.0}
    assert polygons.points_in_polygons(points(spark, [(1, 1), (2, 1), (5, 5)]), df, "left").count() == 4
    two = df.crossJoin(df.select(F.col("id").alias("o"), F.col("parts").alias("other"))).filter("id = 0")
    area = {r["o"]: r["a"] for r in two.select("o", geo.ring_area(polygons.intersect_convex(F.col("parts")[0], F.transform(F.col("other")[0], lambda p: F.struct((p["x"] - 0.5).alias("x"), p["y"].alias("y"))))).alias("a")).collect()}
    assert area[0] == pytest.approx(3.0) and area[1] == pytest.approx(0.5) and area[3] == 0
    rings = builders.h3_rings(spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 9, 1)], "focal long, neighbor long, ring int"), spark.range(3), "inverse")
    assert {r["weight"] for r in rings.links().collect()} == {1.0, 0.5}
    d = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 5.0)], "focal long, neighbor long, distance double")
    assert len(pairs(builders.kernel_from_distances(d, spark.range(3), "triangular", 2.0).eliminate_zeros())) == 2


def test_geometry(spark):
    sq = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in sq],)], "r array<struct<x:double,y:double>>")
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = df.select(geo.ring_area("r" and F.col("r")).alias("a"), geo.perimeter(F.col("r")).alias("p"), geo.centroid(F.col("r")).alias("c"), geo.is_clockwise(F.col("r")).alias("cw"), geo.contains_point(F.col("r"), pt(2.0, 0.5)).alias("edge"), geo.contains_point(F.col("r"), pt(2.1, 0.5)).alias("out"), geo.ring_point_dist(F.col("r"), pt(3.0, 0.5)).alias("d"), geo.bbox(F.col("r")).alias("b"), geo.chain_length(F.col("r")).alias("l")).first()
    assert (r["a"], r["p"], tuple(r["c"]), r["cw"], r["edge"], r["out"], r["d"], tuple(r["b"]), r["l"]) == (2, 6, (1.0, 0.5), False, True, False, 1.0, (0.0, 0.0, 2.0, 1.0), 5.0)
    s = spark.range(1).select(geo.seg_intersect(pt(0.0, 0.0), pt(1.0, 1.0), pt(0.0, 1.0), pt(1.0, 0.0)).alias("x"), geo.segments_intersection(pt(0.0, 0.0), pt(1.0, 1.0), pt(0.0, 1.0), pt(1.0, 0.0)).alias("p"), geo.circumradius(pt(0.0, 0.0), pt(2.0, 0.0), pt(0.0, 2.0)).alias("c"), geo.is_collinear(pt(0.0, 0.0), pt(1.0, 1.0), pt(2.0, 2.0)).alias("l"), geo.segment_point_dist(pt(0.0, 0.0), pt(2.0, 0.0), pt(1.0, 1.0)).alias("d")).first()
    assert s["x"] and tuple(s["p"]) == (0.5, 0.5) and s["c"] == pytest.approx(math.sqrt(2)) and s["l"] and tuple(s["d"]) == (1.0, 0.5)


def test_sphere(spark):
    a, b = (F.lit(-87.893517), F.lit(42.081203)), (F.lit(-87.519295), F.lit(40.758731))
    r = spark.range(1).select(sphere.harcdist(*a, *b).alias("h"), sphere.arcdist(*a, *b).alias("c"), sphere.linear_to_arc(sphere.arc_to_linear(F.lit(100.0))).alias("k"), sphere.to_lnglat(sphere.to_xyz(F.lit(30.0), F.lit(40.0))).alias("p"), sphere.geointerpolate(*a, *b, F.lit(0.0)).alias("g")).first()
    assert r["h"] == pytest.approx(r["c"], rel=1e-6) and r["k"] == pytest.approx(100) and tuple(r["g"]) == pytest.approx((-87.893517, 42.081203))
    assert (math.degrees(r["p"]["lon"]), math.degrees(r["p"]["lat"])) == pytest.approx((30, 40))
    assert sphere.geogrid(spark, (42.0, -86.0), (41.0, -87.0), 3).count() == 16


def test_text_formats(spark, w10, tmp_path):
    ids = Graph(w10.edges.select((F.col("focal") + 1).alias("focal"), (F.col("neighbor") + 1).alias("neighbor"), "weight"), w10.nodes.select((F.col("id") + 1).alias("id")))
    triples = lambda g: {(r["focal"], r["neighbor"]): round(r["weight"], 5) for r in g.links().collect()}
    for form in ("gwt", "kwt", "dat", "mtx", "arcgis_text", "geobugs_text"):
        path = f"{tmp_path}/w_{form}"
        weights_text.write(ids, path, form)
        assert triples(weights_text.read(spark, path, form)) == triples(ids), form
    for form in ("gal", "stata_text"):
        path = f"{tmp_path}/w_{form}"
        weights_text.write(ids, path, form)
        back = weights_text.read(spark, path, form)
        assert pairs(back) == pairs(ids) and back.nodes.count() == 10
    weights_text.write_stata(ids, f"{tmp_path}/full.txt", full=True)
    assert triples(weights_text.read_stata(spark, f"{tmp_path}/full.txt")) == triples(ids)
    weights_text.write(ids.transform("R"), f"{tmp_path}/w.parquet")
    assert weights_text.read(spark, f"{tmp_path}/w.parquet").transformation == "R"
    weights_text.convert(spark, f"{tmp_path}/w_gwt", f"{tmp_path}/c.gal", "gwt")
    assert pairs(weights_text.read(spark, f"{tmp_path}/c.gal")) == pairs(ids)
    (tmp_path / "t.txt").write_text('2,2\n"a","b"\n1,x\n2.5,y\n')
    assert [tuple(r) for r in weights_text.read_geoda_text(spark, f"{tmp_path}/t.txt").collect()] == [(1.0, "x"), (2.5, "y")]
    with pytest.raises(ValueError):
        weights_text.read(spark, "a.xyz")


def test_binary_formats(spark, w10, tmp_path):
    swm = f"{tmp_path}/w.swm"
    binary.write_swm(w10, swm)
    assert binary.read_swm(spark, swm).equals(w10)
    binary.write_dbf_weights(w10, f"{tmp_path}/w.dbf")
    assert pairs(binary.read_dbf_weights(spark, f"{tmp_path}/w.dbf")) == pairs(w10)
    df = queries.squares(spark, SF).select(F.col("id").alias("record"), F.lit("polygon").alias("kind"), "parts", F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") / 4).alias("v"), F.lit(None).cast("date").alias("day"), (F.col("id") > 3).alias("flag"))
    binary.write_table(df, f"{tmp_path}/sq")
    back = binary.read_table(spark, f"{tmp_path}/sq")
    assert [r.asDict(True) for r in back.orderBy("record").collect()] == [r.asDict(True) for r in df.orderBy("record").collect()]
    assert (tmp_path / "sq.shx").stat().st_size == 100 + 8 * 25
    assert binary.duplicates(binary.read_dbf(spark, f"{tmp_path}/sq.dbf"), "name").count() == 0
    text = df.select(binary.to_wkt(F.col("kind"), F.col("parts")).alias("t"))
    (tmp_path / "s.wkt").write_text("\n".join(r["t"] for r in text.collect()) + "\nPOINT (1 2)\nLINESTRING (0 0, 1 1)\n")
    shapes = binary.read_wkt(spark, f"{tmp_path}/s.wkt").collect()
    assert len(shapes) == 27 and len(shapes[0]["parts"][0]) == 4 and shapes[26]["parts"][0][1]["x"] == 1
    wkb = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)
    got = spark.createDataFrame([(bytearray(wkb),), (None,)], "b binary").select(binary.parse_wkb("b").alias("p")).collect()
    assert len(got[0]["p"][0]) == 3 and got[1]["p"] is None


def test_constructors(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "id long, values array<double>")
    g = Graph.from_dense(rows)
    assert pairs(g) == {(0, 1), (1, 0)} and g.isolates().count() == 1
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, id string")
    assert pairs(Graph.from_sparse(g.to_sparse(), nodes)) == {("a", "b"), ("b", "a")}
    assert Graph.from_arrays(spark, [0, 1], [1, 0], [1, 1]).to_dense().count() == 2
    with pytest.raises(ValueError):
        Graph(spark.createDataFrame([(0, 1, "x")], "focal long, neighbor long, weight string"))
    with pytest.raises(ValueError):
        Graph.from_arrays(spark, [0, 0], [1, 1], [1, 1]).validate()
    named = g.remap(spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "id long, new_id string"))
    assert pairs(named) == {("x", "y"), ("y", "x")} and named.nodes.count() == 3


def test_stream(spark, tmp_path):
    edges = builders.lattice(spark, 1, 3).edges
    rows = spark.createDataFrame([(0, 1.0, "2024-01-01 00:10:00"), (2, 2.0, "2024-01-01 00:20:00"), (1, 5.0, "2024-01-01 01:20:00")], "user_id long, value double, t string").select("user_id", "value", F.to_timestamp("t").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in windowed_lag(rows, edges).collect()}
    stream = windowed_lag(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), edges)
    q = stream.writeStream.format("memory").queryName("lagged").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("SELECT * FROM lagged").collect()} == want and len(want) == 3
