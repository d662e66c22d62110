"""Further queries of the catalogue: constructors and views, the older weights surface, file formats, geometry, joins of
polygons, rasters. Each has its SQL over the same tables; files are written to and read from the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry as geo
from ..functions import sphere
from ..operators import builders, joins, polygons, shapes, triangulation, weights
from ..operators.graph import Graph
from ..sources import binary, matrices, tables, weights_text
from .queries import _LL, BANDED, BOTH, DIST, EMB, FULL, INV, KNN, LL, OUT, SPARSE, N, P, Y, _t, add, band, edges, inverse, knn, rounded, rounded_pairs, squares, supplier

LINKS = "l0 AS (SELECT s_suppkey AS focal, s_suppkey % 7 + 1 AS neighbor, (s_nationkey + 1)::DOUBLE AS weight FROM supplier)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select(k.alias("focal"), (k % 7 + 1).alias("neighbor"), (F.col("s_nationkey") + 1).cast("double").alias("weight"))


def listed(spark, sf) -> list:
    return [tuple(r) for r in links(spark, sf).collect()]  # constructors from lists hold a graph that fits the driver


def from_dicts(s, d):
    return Graph.from_dicts(s, {a: [b] for a, b, _ in listed(s, d)}, {a: [w] for a, _, w in listed(s, d)})


LINKED = f"WITH {LINKS} SELECT focal, neighbor, weight FROM l0"
add("from_adjacency", lambda s, d: edges(Graph.from_adjacency(links(s, d).toDF("a", "b", "c"), "a", "b", "c")), LINKED)
add("from_arrays", lambda s, d: edges(Graph.from_arrays(s, *zip(*listed(s, d), strict=True))), LINKED)
add("from_dicts", lambda s, d: edges(from_dicts(s, d)), LINKED)
add("from_weights_dict", lambda s, d: edges(Graph.from_weights_dict(s, {a: {b: w} for a, b, w in listed(s, d)})), LINKED)
add("from_adjlist", lambda s, d: edges(weights.Weights.from_adjlist(links(s, d), weight_col="weight").graph), f"WITH {LINKS}, e0 AS (SELECT * FROM l0 WHERE focal <> neighbor), n AS (SELECT s_suppkey AS id FROM supplier), {FULL()} {OUT}")
add("to_adjlist_once", lambda s, d: rounded(weights.Weights(band(s, d)).to_adjlist(remove_symmetric=True)), f"WITH {BANDED} SELECT focal, neighbor, weight FROM e0 WHERE focal < neighbor")
add("remap_ids", lambda s, d: edges(knn(s, d).remap(supplier(s, d).select("id", (F.col("id") + 1000).alias("new_id")))), f"WITH {KNN} SELECT focal + 1000 AS focal, neighbor + 1000 AS neighbor, weight FROM k0")


def matrix(spark, sf):
    k = F.col("n_nationkey").cast("bigint")
    return _t(spark, sf, "nation").select(k.alias("id"), F.transform(F.sequence(F.lit(0), F.lit(24)), lambda j: F.when((k + j) % 5 == 0, (j + 1).cast("double")).otherwise(0.0)).alias("values"))


_MATRIX = "m AS (SELECT n_nationkey::BIGINT AS i, v AS j, CASE WHEN (n_nationkey + v) % 5 = 0 THEN (v + 1)::DOUBLE ELSE 0 END AS w FROM nation, (SELECT unnest(range(25)) AS v))"
add("from_dense", lambda s, d: edges(Graph.from_dense(matrix(s, d))), f"WITH {_MATRIX} SELECT i AS focal, j AS neighbor, w AS weight FROM m WHERE w <> 0")
add("edge_list", lambda s, d: matrices.edge_list(matrix(s, d)), f"WITH {_MATRIX} SELECT i AS row, j AS col FROM m WHERE w <> 0")
add("to_dense_sums", lambda s, d: rounded(Graph.from_dense(matrix(s, d)).to_dense().select("id", sum((F.col(f"`{k}`") for k in range(25)), F.lit(0.0)).alias("total"))), f"WITH {_MATRIX} SELECT i AS id, sum(w) AS total FROM m GROUP BY i")
_PLACE = "o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord FROM n)"
add("to_sparse", lambda s, d: rounded(inverse(s, d).to_sparse()), f"WITH {INV}, {_PLACE} SELECT a.ord AS i, b.ord AS j, round(weight, 6) AS w FROM e0 JOIN o a ON focal = a.id JOIN o b ON neighbor = b.id WHERE weight <> 0")
add("from_sparse", lambda s, d: edges(weights.SparseWeights.from_weights(weights.Weights(knn(s, d))).to_weights().graph), f"WITH {KNN}, {FULL('k0')} {OUT}")
add("place_of_ids", lambda s, d: weights.Weights(band(s, d)).places(), f"WITH {P}, {N}, {_PLACE} SELECT id, ord FROM o")
add("sparse_diag", lambda s, d: rounded(weights.SparseWeights.from_weights(weights.Weights(inverse(s, d))).diag_gtg_gg()), f"WITH {INV}, g AS (SELECT x.focal AS id, sum(x.weight * y.weight) AS g FROM e0 x JOIN e0 y ON x.focal = y.neighbor AND x.neighbor = y.focal GROUP BY 1), b AS (SELECT neighbor AS id, sum(weight * weight) AS q FROM e0 GROUP BY 1) SELECT n.id, round(coalesce(g, 0) + coalesce(q, 0), 6) AS diag FROM n LEFT JOIN g USING (id) LEFT JOIN b USING (id)")

# views
add("neighbors", lambda s, d: knn(s, d).neighbors().select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), F.size("weights").cast("bigint").alias("n")), f"WITH {KNN} SELECT focal AS id, string_agg(neighbor::VARCHAR, ',' ORDER BY neighbor) AS neighbors, count(*) AS n FROM k0 GROUP BY focal")
add("one_focal", lambda s, d: rounded(inverse(s, d)[1]), f"WITH {INV} SELECT neighbor, round(weight, 6) AS weight FROM e0 WHERE focal = 1")
add("unique_ids", lambda s, d: band(s, d).unique_ids(), "SELECT s_suppkey AS id FROM supplier")
add("n_components", lambda s, d: SPARSE(s, d).n_components(), f"WITH RECURSIVE {P}, {DIST}, t AS (SELECT id, id AS o FROM p UNION SELECT t.id, d.neighbor FROM t JOIN d ON t.o = d.focal WHERE d.d <= 15) SELECT count(DISTINCT m) AS n_components FROM (SELECT id, min(o) AS m FROM t GROUP BY id)")
add("aggregate", lambda s, d: rounded(inverse(s, d).aggregate(F.sum("weight").alias("total"), F.max("weight").alias("most"))), f"WITH {INV} SELECT focal AS id, round(sum(weight), 6) AS total, round(max(weight), 6) AS most FROM e0 WHERE weight <> 0 OR focal <> neighbor GROUP BY focal")
add("apply", lambda s, d: rounded(knn(s, d).apply(Y(s, d), F.max("y").alias("most"), F.avg("y").alias("mean"))), f"WITH {KNN} SELECT focal AS id, max(y) AS most, round(avg(y), 6) AS mean FROM k0 JOIN p ON neighbor = id GROUP BY focal")
add("apply_in_pandas", lambda s, d: rounded(knn(s, d).apply_in_pandas(Y(s, d), lambda pdf: pdf.groupby("focal", as_index=False)["y"].agg(lambda y: float(y.max() - y.min())).rename(columns={"focal": "id", "y": "span"}), "id bigint, span double")), f"WITH {KNN} SELECT focal AS id, max(y) - min(y) AS span FROM k0 JOIN p ON neighbor = id GROUP BY focal")
add("edge_lines", lambda s, d: rounded(knn(s, d).edge_lines(supplier(s, d)).drop("weight")), f"WITH {KNN} SELECT focal, neighbor, round(a.x, 6) AS x0, a.y AS y0, round(b.x, 6) AS x1, b.y AS y1 FROM k0 JOIN p a ON focal = a.id JOIN p b ON neighbor = b.id")
add("geojson_edges", lambda s, d: knn(s, d).geojson(supplier(s, d).select("id", F.col("id").cast("double").alias("x"), "y")).select("feature"), f"""WITH {KNN} SELECT '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[' || focal || '.0,' || a.y::BIGINT || '.0],[' || neighbor || '.0,' || b.y::BIGINT || '.0]]}},"properties":{{"focal":' || focal || ',"neighbor":' || neighbor || ',"weight":1.0}}}}' AS feature FROM k0 JOIN p a ON focal = a.id JOIN p b ON neighbor = b.id""")
add("diag_gtg_gg", lambda s, d: rounded(knn(s, d).diag_gtg_gg()), f"WITH {KNN}, g AS (SELECT x.focal AS id, count(*) AS g FROM k0 x JOIN k0 y ON x.focal = y.neighbor AND x.neighbor = y.focal GROUP BY 1), b AS (SELECT neighbor AS id, count(*) AS q FROM k0 GROUP BY 1) SELECT n.id, (coalesce(g, 0) + coalesce(q, 0))::DOUBLE AS diag FROM n LEFT JOIN g USING (id) LEFT JOIN b USING (id)")
add("isolates_of_sparse", lambda s, d: SPARSE(s, d).isolates(), f"WITH {P}, {DIST} SELECT id FROM p WHERE id NOT IN (SELECT focal FROM d WHERE d <= 15)")
_DISTRIBUTION = "avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max"
add("weight_distribution", lambda s, d: rounded(inverse(s, d).distribution().filter("what = 'weight'").select("mean", "std", "min", "p25", "p50", "p75", "max")), f"WITH {INV}, w AS (SELECT weight AS v FROM e0 WHERE weight <> 0 OR focal <> neighbor), t AS (SELECT {_DISTRIBUTION} FROM w) SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(max, 6) AS max FROM t")
add("modal_lag_random_among_modes", lambda s, d: knn(s, d).lag(Y(s, d).select("id", F.concat(F.lit("g"), (F.col("y") % 4).cast("int")).alias("y")), ties="random", seed=3).join(knn(s, d).edges.join(Y(s, d).select(F.col("id").alias("neighbor"), F.concat(F.lit("g"), (F.col("y") % 4).cast("int")).alias("lag")), "neighbor").groupBy(F.col("focal").alias("id"), "lag").agg(F.count(F.lit(1)).alias("n")), ["id", "lag"]).select("id", "n"), f"WITH {KNN}, m AS (SELECT focal, s_nationkey % 4 AS y, count(*) AS c FROM k0 JOIN supplier ON neighbor = s_suppkey GROUP BY 1, 2) SELECT focal AS id, max(c) AS n FROM m GROUP BY focal")


def predicates(s: SparkSession, d: str) -> DataFrame:
    a, b = knn(s, d), band(s, d)
    a = Graph(scratch.write(a.edges)[0], a.nodes)  # asked many times, so worked out once
    both = a.intersection(b)
    both = Graph(scratch.write(both.edges)[0], both.nodes)
    rows = {
        "intersects": a.intersects(b), "sub": both <= a, "sub_not": a <= both, "super": a >= both, "equal": both == b.intersection(a), "unequal": a != b, "proper": both < a, "isomorphic": a.isomorphic(a.remap(supplier(s, d).select("id", (-F.col("id")).alias("new_id")))),
        "not_isomorphic": both.isomorphic(a), "same_neighbors": weights.neighbor_equality(a, a.transform("R")),
    }
    return s.createDataFrame([tuple(bool(x) for x in rows.values())], ", ".join(f"`{k}` boolean" for k in rows))


_BOTH = f"WITH {BOTH}, i AS (SELECT focal, neighbor FROM k0 INTERSECT SELECT * FROM e1), a AS (SELECT count(*) AS n FROM k0), b AS (SELECT count(*) AS n FROM i)"
add("set_predicates", predicates, _BOTH + ', e AS (SELECT count(*) AS n FROM (SELECT focal, neighbor FROM k0 EXCEPT SELECT * FROM e1) UNION ALL SELECT count(*) FROM (SELECT * FROM e1 EXCEPT SELECT focal, neighbor FROM k0)) SELECT b.n > 0 AS "intersects", true AS sub, a.n = b.n AS sub_not, true AS super, true AS equal, (SELECT sum(n) FROM e) > 0 AS unequal, b.n < a.n AS proper, true AS isomorphic, a.n = b.n AS not_isomorphic, true AS same_neighbors FROM a, b')

# the older weights surface
W = lambda s, d: weights.Weights(SPARSE(s, d))
_S = f"{P}, {N}, {DIST}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM d WHERE d <= 15), c AS (SELECT id, count(focal) AS k FROM n LEFT JOIN e0 ON id = focal GROUP BY id)"
add("w_cardinalities", lambda s, d: W(s, d).cardinalities(), f"WITH {_S} SELECT id, k AS cardinality FROM c")
add("w_properties", lambda s, d: rounded(W(s, d).properties().select("n", "nonzero", "max_neighbors", "min_neighbors", "mean_neighbors", "pct_nonzero")), f"WITH {_S} SELECT count(*) AS n, sum(k)::BIGINT AS nonzero, max(k) AS max_neighbors, min(k) AS min_neighbors, round(avg(k), 6) AS mean_neighbors, round(100.0::DOUBLE * sum(k) / count(*) ** 2, 6) AS pct_nonzero FROM c")
add("w_islands", lambda s, d: W(s, d).islands(), f"WITH {_S} SELECT id FROM c WHERE k = 0")
add("w_symmetrize", lambda s, d: edges(weights.Weights(knn(s, d)).symmetrize().graph), f"WITH {KNN} SELECT focal, neighbor, weight FROM k0 UNION SELECT neighbor, focal, weight FROM k0")
add("w_neighbor_offsets", lambda s, d: weights.Weights(knn(s, d)).neighbor_offsets().select("i", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets")), f"WITH {KNN}, {_PLACE} SELECT a.ord AS i, string_agg(b.ord::VARCHAR, ',' ORDER BY b.ord) AS offsets FROM k0 JOIN o a ON focal = a.id JOIN o b ON neighbor = b.id GROUP BY 1")


def restored(s, d):
    w = weights.Weights(inverse(s, d))
    w.transform = "R"
    w.transform = "B"
    return edges(w.graph)


add("w_set_transform", restored, f"WITH {INV}, {FULL(out='e1')}, e AS (SELECT focal, neighbor, (weight <> 0)::INT::DOUBLE AS weight FROM e1) {OUT}")
_CAT = f"WITH {INV}, t AS (SELECT focal, 'g' || (s_nationkey % 4) AS y, sum(weight) AS t FROM e0 JOIN supplier ON neighbor = s_suppkey GROUP BY 1, 2)"
CAT = lambda s, d: Y(s, d).select("id", F.concat(F.lit("g"), (F.col("y") % 4).cast("int")).alias("y"))
add("w_lag_categorical", lambda s, d: weights.Weights(inverse(s, d)).lag_categorical(CAT(s, d), ties="lowest"), f"{_CAT} SELECT focal AS id, y AS lag FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY t DESC, y) AS r FROM t) WHERE r = 1")
add("w_adjlist_apply", lambda s, d: rounded(weights.adjlist_apply(knn(s, d).edges.drop("weight"), Y(s, d), lambda a, b: F.abs(a - b), "y").select("focal", "neighbor", "y_apply")), f"WITH {KNN} SELECT focal, neighbor, abs(a.y - b.y) AS y_apply FROM k0 JOIN p a ON focal = a.id JOIN p b ON neighbor = b.id")
add("w_filter_adjlist", lambda s, d: weights.filter_adjlist(knn(s, d).edges).select("focal", "neighbor"), f"WITH {KNN} SELECT focal, neighbor FROM (SELECT *, row_number() OVER (PARTITION BY least(focal, neighbor), greatest(focal, neighbor) ORDER BY focal) AS r FROM k0) WHERE r = 1")
for _k, _f, _x in (
    ("union", weights.union, "SELECT focal, neighbor FROM k0 UNION SELECT * FROM e1"), ("intersection", weights.intersection, "SELECT focal, neighbor FROM k0 INTERSECT SELECT * FROM e1"),
    ("difference", weights.difference, "SELECT focal, neighbor FROM k0 EXCEPT SELECT * FROM e1"), ("symmetric_difference", weights.symmetric_difference, "(SELECT focal, neighbor FROM k0 EXCEPT SELECT * FROM e1) UNION (SELECT * FROM e1 EXCEPT SELECT focal, neighbor FROM k0)"),
):
    add(f"w_{_k}", lambda s, d, f=_f: edges(f(knn(s, d), band(s, d))), f"WITH {BOTH}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM ({_x})), {FULL()} {OUT}")
add("w_encode_labels", lambda s, d: weights.encode_labels(_t(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment").select("id", "code"), "SELECT c_custkey AS id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
add("w_combinations", lambda s, d: weights.combinations(_t(s, d, "nation").select(F.col("n_nationkey").alias("id")), 3).select(*[F.col(f"c{k}").cast("bigint").alias(f"c{k}") for k in (1, 2, 3)]), "SELECT a.n_nationkey::BIGINT AS c1, b.n_nationkey::BIGINT AS c2, c.n_nationkey::BIGINT AS c3 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey")

# files


def _file(spark: SparkSession, ending: str) -> str:
    return f"{scratch.root(spark)}/edgeloom-file-{uuid.uuid4().hex}.{ending}"


def through(form: str, source=knn, shift: int = 0):
    def plan(spark: SparkSession, sf: str) -> DataFrame:
        path = _file(spark, form)
        tables_of = {"mat": (matrices.read_mat, matrices.write_mat), "wk1": (matrices.read_wk1, matrices.write_wk1)}
        readers = {**{k: (r, weights_text.WRITERS[k]) for k, r in weights_text.READERS.items() if k in weights_text.WRITERS}, **tables_of, "swm": (binary.read_swm, binary.write_swm), "dbf": (binary.read_dbf_weights, binary.write_dbf_weights)}
        read, write = readers[form]
        write(source(spark, sf), path)
        e = read(spark, path).edges
        return rounded(e.select(*[(F.col(c).cast("bigint") + shift).alias(c) for c in ("focal", "neighbor")], "weight"))

    return plan


def small(s, d):
    n = _t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("regime"))
    return Graph(builders.block_contiguity(n).edges, n)


_KNNS = f"WITH {KNN}, {FULL('k0')} {OUT}"
for _k in ("gal", "gwt", "kwt", "dat", "stata_text", "arcgis_text", "parquet", "swm", "dbf"):
    add(f"file_{_k}", through(_k), _KNNS)
for _k in ("mtx", "geobugs_text"):  # formats of places from 1 on
    add(f"file_{_k}", through(_k, lambda s, d: knn(s, d).remap(supplier(s, d).select("id", (F.col("id") + 1).alias("new_id"))), -1), _KNNS)
add("file_mat", through("mat"), _KNNS)
add("file_wk1", through("wk1", small), "SELECT a.n_nationkey::BIGINT AS focal, b.n_nationkey::BIGINT AS neighbor, 1::DOUBLE AS weight FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")


def converted(s, d):
    a, b = _file(s, "gal"), _file(s, "gwt")
    weights_text.write(knn(s, d), a)
    weights_text.convert(s, a, b)
    return edges(tables.read(s, b))


add("file_convert", converted, _KNNS)


def grid_gal(s, d):
    path = _file(s, "gal")
    weights_text.write_grid_gal(s, path, int(_t(s, d, "supplier").count() ** 0.5) + 1)
    return edges(weights_text.read_gal(s, path))


add("file_grid_gal", grid_gal, "WITH k AS (SELECT floor(sqrt(count(*)))::BIGINT + 1 AS n FROM supplier), g AS (SELECT a.i * n + b.i AS id, a.i AS r, b.i AS c FROM k, range((SELECT n FROM k)) a(i), range((SELECT n FROM k)) b(i)) SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1")


def csv_table(s, d):
    path = _file(s, "csv")
    _t(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return tables.by_column(tables.read(s, path, types={"s_suppkey": "bigint"}), "s_suppkey", "s_name", "s_acctbal")


add("table_csv", csv_table, "SELECT s_suppkey, s_name, s_acctbal FROM supplier")


def dbf_table(s, d):
    path = _file(s, "dbf")
    binary.write_dbf(_t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("KEY"), F.col("n_name").alias("NAME")), path, "KEY")
    return tables.read(s, path).select(F.col("KEY").cast("bigint").alias("key"), F.trim("NAME").alias("name"))


add("table_dbf", dbf_table, "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")


def shapefile(s, d):
    path = _file(s, "shp")
    binary.write_shp(squares(s, d).select(F.col("id").alias("record"), F.lit("polygon").alias("kind"), "parts"), path)
    got = tables.read(s, path)
    return rounded(got.select(geo.ring_area(F.col("parts")[0]).alias("area"), geo.bbox(F.col("parts")[0])["left"].alias("left"), geo.bbox(F.col("parts")[0])["lower"].alias("lower")))


add("table_shp", shapefile, "SELECT 1::DOUBLE AS area, (n_nationkey % 5)::DOUBLE AS \"left\", (n_nationkey // 5)::DOUBLE AS lower FROM nation")


def rows_by_place(s, d):
    return tables.rows_between(_t(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 10, 30)


add("table_rows", rows_by_place, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")

# points
add("distance_matrix", lambda s, d: rounded_pairs(builders.all_pairs(supplier(s, d)), "distance"), f"WITH {P}, {DIST} SELECT focal, neighbor, round(d, 6) AS distance FROM d")
add("distance_matrix_city_block", lambda s, d: rounded_pairs(builders.all_pairs(supplier(s, d), 1), "distance"), f"WITH {P} SELECT a.id AS focal, b.id AS neighbor, round(abs(a.x - b.x) + abs(a.y - b.y), 6) AS distance FROM p a JOIN p b ON a.id <> b.id")
add("quartile_of_distances", lambda s, d: s.createDataFrame([(round(builders.distance_quantile(supplier(s, d), 0.25, enough=500), 6),)], "q double"), f"WITH {P}, {DIST} SELECT round(quantile_cont(d, 0.25), 6) AS q FROM d")
CUST = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
_CUST = "c AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer)"
_NEAR = "sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))"
add("knn_two_sets", lambda s, d: rounded(builders.nearest(CUST(s, d), supplier(s, d), 3)), f"WITH {P}, {_CUST} SELECT focal, neighbor, round(d, 6) AS distance FROM (SELECT c.id AS focal, p.id AS neighbor, {_NEAR} AS d, row_number() OVER (PARTITION BY c.id ORDER BY {_NEAR}, p.id) AS r FROM c, p) WHERE r <= 3")
CLUSTER = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") == 7, 1e7).when(F.col("c_custkey") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.col("c_acctbal") / 1000, F.lit(5))).alias("x"), F.when(F.col("c_custkey") % 3 == 0, F.lit(5.0)).otherwise((F.col("c_custkey") * 37 % 1009).cast("double") / 1009).alias("y"))
_CLUSTER = "p AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 1e7::DOUBLE WHEN c_custkey % 3 = 0 THEN 5 ELSE pow(c_acctbal / 1000, 5) END AS x, CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE (c_custkey * 37 % 1009)::DOUBLE / 1009 END AS y FROM customer)"
add("knn_clustered", lambda s, d: edges(builders.knn(CLUSTER(s, d), 3)), f"WITH {_CLUSTER}, {DIST} SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d, neighbor) AS r FROM d) WHERE r <= 3")
add("knn_city_block", lambda s, d: edges(builders.knn(supplier(s, d), 3, metric="manhattan")), f"WITH {P} SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT a.id AS focal, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.id) AS r FROM p a JOIN p b ON a.id <> b.id) WHERE r <= 3")
_ARC = "2 * asin(sqrt(least(1, sin(radians(a.lat - b.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) * 6371"
JLL = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_acctbal") * 7919, F.lit(360.0)) - 180).alias("lon"), (F.pmod(F.col("c_acctbal") * 104729, F.lit(170.0)) - 85).alias("lat"))
_JLL = "p0 AS (SELECT c_custkey AS id, c_acctbal * 7919 AS u, c_acctbal * 104729 AS v FROM customer), p AS (SELECT id, u - 360::DOUBLE * floor(u / 360) - 180 AS lon, v - 170::DOUBLE * floor(v / 170) - 85 AS lat FROM p0)"
add("knn_haversine", lambda s, d: joins.sphere_knn_join(JLL(s, d), 2).select("focal", "neighbor", F.round("distance", 2).alias("distance")), f"WITH {_JLL}, d AS (SELECT a.id AS focal, b.id AS neighbor, {_ARC} AS d FROM p a JOIN p b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d) AS r FROM d) SELECT focal, neighbor, round(d, 2) AS distance FROM r WHERE r <= 2")
add("kernel_haversine", lambda s, d: rounded_pairs(builders.kernel(LL(s, d), "triangular", bandwidth=700.0, metric="haversine").edges, "weight"), f"WITH {_LL}, n AS (SELECT id FROM p), e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1 - {_ARC} / 700 AS weight FROM p a JOIN p b ON a.id <> b.id AND {_ARC} <= 700), {FULL()} {OUT}")
add("knn_reweight", lambda s, d: edges(builders.reweight(knn(s, d), supplier(s, d), 2, s.createDataFrame([(-1, 100.0, 3.0)], "id bigint, x double, y double"))), f"WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier UNION ALL SELECT -1, 100, 3), {DIST} SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d, neighbor) AS r FROM d) WHERE r <= 2")
add("ball_points", lambda s, d: joins.band_join(supplier(s, d).filter("id <= 3"), supplier(s, d), 900.0).select("focal", "neighbor"), f"WITH {P} SELECT a.id AS focal, b.id AS neighbor FROM p a, p b WHERE a.id <= 3 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 900")
add("ball_pairs", lambda s, d: joins.band_join(supplier(s, d), supplier(s, d), 300.0).filter("focal < neighbor").select("focal", "neighbor"), f"WITH {P}, {DIST} SELECT focal, neighbor FROM d WHERE d <= 300 AND focal < neighbor")
add("ball_counts", lambda s, d: joins.band_join(CUST(s, d), supplier(s, d), 50.0).agg(F.count(F.lit(1)).alias("pairs")), f"WITH {P}, {_CUST} SELECT count(*) AS pairs FROM c, p WHERE {_NEAR} <= 50")
add("sparse_distances", lambda s, d: rounded(joins.band_join(supplier(s, d), supplier(s, d), 300.0).filter("distance > 0")), f"WITH {P}, {DIST} SELECT focal, neighbor, round(d, 6) AS distance FROM d WHERE d <= 300 AND d > 0")
add("points_in_box", lambda s, d: CUST(s, d).filter(geo.rectangle_contains(geo.rectangle(F.lit(0.0), F.lit(3.0), F.lit(5000.0), F.lit(9.0)), F.struct("x", "y"))).select("id"), f"WITH {_CUST} SELECT id FROM c WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 3 AND 9")


def segments(s, d):
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return _t(s, d, "supplier").select(k.alias("id"), p(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("p"), p(F.col("s_acctbal") + k % 5 * 10, F.col("s_nationkey") + k % 3 * 2.0).alias("q"))


_SEG = f"""{_CUST}, g AS (SELECT s_suppkey AS id, s_acctbal AS px, s_nationkey::DOUBLE AS py, (s_suppkey % 5 * 10)::DOUBLE AS dx, s_suppkey % 3 * 2.0::DOUBLE AS dy FROM supplier),
t AS (SELECT c.id, g.id AS segment_id, x - px AS vx, y - py AS vy, dx, dy, greatest(0, least(1, coalesce(((x - px) * dx + (y - py) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM c, g),
u AS (SELECT id, segment_id, sqrt((vx - t * dx) ** 2 + (vy - t * dy) ** 2) AS d FROM t)"""
add("nearest_segment", lambda s, d: joins.segment_nearest_join(CUST(s, d), segments(s, d)).select("id", F.round("distance", 5).alias("distance")), f"WITH {_SEG} SELECT id, round(min(d), 5) AS distance FROM u GROUP BY id")

# polygons that grow with the tables: a rectangle for each supplier
LOT_W, LOT_H = "0.5 + s_nationkey % 3 * 0.5", "0.5 + s_suppkey % 4 * 0.25"


def lots(s, d):
    k = F.col("s_suppkey")
    x, y = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    box = geo.rectangle(x, y, x + F.expr(LOT_W), y + F.expr(LOT_H))
    return _t(s, d, "supplier").select(k.alias("id"), box.alias("b")).select("id", "b.*")


def lot_parts(s, d):
    return shapes.as_parts(lots(s, d))


def dealt(rows):
    """Rows dealt out to as many tasks as a shuffle has: a small table is one split, however much work a row is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


_LOTS = f"q AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS l, (s_suppkey // 10)::DOUBLE AS b, s_suppkey % 10 + {LOT_W} AS r, s_suppkey // 10 + {LOT_H} AS t FROM supplier), q2 AS (SELECT id, l::DOUBLE AS l, b::DOUBLE AS b, r::DOUBLE AS r, t::DOUBLE AS t FROM q)"
_MEET = "a.l <= c.r AND c.l <= a.r AND a.b <= c.t AND c.b <= a.t"
_SQUARE = "c AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 5)::DOUBLE AS l, (n_nationkey // 5)::DOUBLE AS b, n_nationkey % 5 + 1::DOUBLE AS r, n_nationkey // 5 + 1::DOUBLE AS t FROM nation)"
add("polygon_join", lambda s, d: shapes.spatial_join(lot_parts(s, d), squares(s, d)), f"WITH {_LOTS}, {_SQUARE} SELECT a.id AS left_id, c.id AS right_id FROM q2 a JOIN c ON {_MEET}")
add("polygon_join_within", lambda s, d: shapes.spatial_join(lot_parts(s, d), squares(s, d), predicate="within"), f"WITH {_LOTS}, {_SQUARE} SELECT a.id AS left_id, c.id AS right_id FROM q2 a JOIN c ON a.l >= c.l AND a.r <= c.r AND a.b >= c.b AND a.t <= c.t")
add("polygon_join_contains_left", lambda s, d: shapes.spatial_join(squares(s, d), lot_parts(s, d), "left", "contains"), f"WITH {_LOTS}, {_SQUARE} SELECT c.id AS left_id, a.id AS right_id FROM c LEFT JOIN q2 a ON a.l >= c.l AND a.r <= c.r AND a.b >= c.b AND a.t <= c.t")
add("polygon_join_overlaps_right", lambda s, d: shapes.spatial_join(lot_parts(s, d), squares(s, d), "right", "overlaps"), f"WITH {_LOTS}, {_SQUARE} SELECT a.id AS left_id, c.id AS right_id FROM c LEFT JOIN q2 a ON a.l < c.r AND c.l < a.r AND a.b < c.t AND c.b < a.t AND NOT (a.l >= c.l AND a.r <= c.r AND a.b >= c.b AND a.t <= c.t) AND NOT (c.l >= a.l AND c.r <= a.r AND c.b >= a.b AND c.t <= a.t)")
add("polygon_join_touches", lambda s, d: shapes.spatial_join(lot_parts(s, d), squares(s, d), predicate="touches"), f"WITH {_LOTS}, {_SQUARE} SELECT a.id AS left_id, c.id AS right_id FROM q2 a JOIN c ON {_MEET} AND NOT (a.l < c.r AND c.l < a.r AND a.b < c.t AND c.b < a.t)")
_OVER = "greatest(0, least(a.r, c.r) - greatest(a.l, c.l)) * greatest(0, least(a.t, c.t) - greatest(a.b, c.b))"
AREA = lambda df: df.withColumn("area", shapes.polygon_area(F.col("parts")))
add("overlay_intersection", lambda s, d: rounded(AREA(shapes.overlay(lot_parts(s, d), squares(s, d))).select("left_id", "right_id", "area")), f"WITH {_LOTS}, {_SQUARE} SELECT a.id AS left_id, c.id AS right_id, round({_OVER}, 6) AS area FROM q2 a JOIN c ON {_OVER} > 0")
_LEFT = f"WITH {_LOTS}, {_SQUARE}, v AS (SELECT a.id, (a.r - a.l) * (a.t - a.b) - coalesce(sum(CASE WHEN c.id IS NOT NULL THEN {_OVER} END), 0) AS area FROM q2 a LEFT JOIN c ON {_OVER} > 0 GROUP BY a.id, a.l, a.r, a.b, a.t)"
add("overlay_difference", lambda s, d: rounded(AREA(shapes.overlay(lot_parts(s, d), squares(s, d), "difference")).select("left_id", "area")), f"{_LEFT} SELECT id AS left_id, round(area, 6) AS area FROM v WHERE area > 1e-9")
add("overlay_identity", lambda s, d: rounded(AREA(shapes.overlay(lot_parts(s, d), squares(s, d), "identity")).groupBy("left_id").agg(F.sum("area").alias("area"))), f"WITH {_LOTS} SELECT id AS left_id, round((r - l) * (t - b), 6) AS area FROM q2")


def tiles(s, d):
    """Two layers that don't overlap themselves: unit squares, and squares of side 1 moved by a half."""
    half = squares(s, d).select("id", F.transform("parts", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y")))).alias("parts"))
    return squares(s, d), half


for _k, _x in {"union": "25 + 25 - 20.25", "symmetric_difference": "2 * (25 - 20.25)"}.items():
    add(f"overlay_{_k}", lambda s, d, k=_k: rounded(AREA(shapes.overlay(*tiles(s, d), k)).agg(F.sum("area").alias("area"))), f"SELECT round((count(*) * 0 + {_x})::DOUBLE, 6) AS area FROM nation")
add("dissolve_rings", lambda s, d: rounded(shapes.union(squares(s, d).withColumn("g", F.col("id") % 3), "g").select(F.col("group"), shapes.polygon_area(F.col("parts")).alias("area"), F.aggregate("parts", F.lit(0.0), lambda a, r: a + geo.perimeter(r)).alias("perimeter"))), """
WITH q AS (SELECT n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_nationkey::BIGINT % 3 AS g FROM nation), s AS (SELECT g, x, y, 0 AS v FROM q UNION ALL SELECT g, x, y + 1, 0 FROM q UNION ALL SELECT g, x, y, 1 FROM q UNION ALL SELECT g, x + 1, y, 1 FROM q),
o AS (SELECT g, count(*) AS n FROM (SELECT g, x, y, v FROM s GROUP BY ALL HAVING count(*) = 1) GROUP BY g) SELECT g AS "group", (SELECT count(*) FROM q WHERE q.g = o.g)::DOUBLE AS area, n::DOUBLE AS perimeter FROM o""")
add("common_part", lambda s, d: rounded(AREA(shapes.intersection(shapes.as_parts(_t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") / 10.0).alias("left"), F.lit(0.0).alias("lower"), (F.col("s_nationkey") / 10.0 + 5).alias("right"), (F.lit(2.0) + F.col("s_nationkey") / 7.0).alias("upper")))).select("parts")).select("area")), "SELECT round((min(s_nationkey / 10.0::DOUBLE) + 5 - max(s_nationkey / 10.0::DOUBLE)) * min(2 + s_nationkey / 7.0::DOUBLE), 6) AS area FROM supplier")
_GAP = "sqrt(greatest(0, a.l - c.r, c.l - a.r) ** 2 + greatest(0, a.b - c.t, c.b - a.t) ** 2)"
add("fuzzy_contiguity", lambda s, d: edges(shapes.fuzzy_contiguity(lot_parts(s, d), buffer=0.2)), f"WITH {_LOTS}, n AS (SELECT id FROM q2), e0 AS (SELECT a.id AS focal, c.id AS neighbor, 1::DOUBLE AS weight FROM q2 a JOIN q2 c ON a.id <> c.id AND {_GAP} <= 0.4 + 1e-12), {FULL()} {OUT}")
add("fuzzy_contiguity_contains", lambda s, d: edges(shapes.fuzzy_contiguity(lot_parts(s, d), predicate="contains")), f"WITH {_LOTS}, n AS (SELECT id FROM q2), e0 AS (SELECT a.id AS focal, c.id AS neighbor, 1::DOUBLE AS weight FROM q2 a JOIN q2 c ON a.id <> c.id AND c.l >= a.l AND c.r <= a.r AND c.b >= a.b AND c.t <= a.t), {FULL()} {OUT}")
add("fuzzy_contiguity_boxes", lambda s, d: edges(shapes.fuzzy_contiguity(lot_parts(s, d), predicate=None)), f"WITH {_LOTS}, n AS (SELECT id FROM q2), e0 AS (SELECT a.id AS focal, c.id AS neighbor, 1::DOUBLE AS weight FROM q2 a JOIN q2 c ON a.id <> c.id AND {_MEET}), {FULL()} {OUT}")


def loose(s, d):
    """A graph of the lots in which every third is an isolate."""
    q = lot_parts(s, d)
    return Graph(shapes.fuzzy_contiguity(q).links().filter("focal % 3 <> 0 AND neighbor % 3 <> 0"), q)


add("nonplanar_neighbors", lambda s, d: edges(shapes.nonplanar_neighbors(loose(s, d), lot_parts(s, d), 0.02)[0]), f"""
WITH {_LOTS}, n AS (SELECT id FROM q2), l AS (SELECT a.id AS focal, c.id AS neighbor FROM q2 a JOIN q2 c ON a.id <> c.id AND {_MEET} AND a.id % 3 <> 0 AND c.id % 3 <> 0), i AS (SELECT * FROM q2 WHERE id NOT IN (SELECT focal FROM l)),
h AS (SELECT 0.02::DOUBLE * least(max(r) - min(l), max(t) - min(b)) AS h FROM q2), x AS (SELECT a.id AS focal, c.id AS neighbor FROM i a JOIN q2 c ON a.id <> c.id JOIN h ON {_GAP} <= h + 1e-12),
e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT * FROM l UNION SELECT * FROM x UNION SELECT neighbor, focal FROM x)), {FULL()} {OUT}""")
add("polygon_distances", lambda s, d: rounded(shapes.candidates(lot_parts(s, d), lot_parts(s, d), 1.0).filter("l_id < r_id").select(F.col("l_id").alias("focal"), F.col("r_id").alias("neighbor"), shapes.polygon_distance(F.col("l_parts"), F.col("r_parts")).alias("distance"))), f"WITH {_LOTS} SELECT a.id AS focal, c.id AS neighbor, round({_GAP}, 6) AS distance FROM q2 a JOIN q2 c ON a.id < c.id AND a.l - 1 <= c.r AND c.l <= a.r + 1 AND a.b - 1 <= c.t AND c.b <= a.t + 1")
add("polygon_measures_of_lots", lambda s, d: rounded(lot_parts(s, d).select("id", shapes.polygon_area(F.col("parts")).alias("area"), geo.perimeter(F.col("parts")[0]).alias("perimeter"), geo.centroid(F.col("parts")[0])["x"].alias("cx"), shapes.polygon_area(shapes.envelope(F.col("parts"))).alias("box"), shapes.polygon_area(shapes.hull_of(F.col("parts"))).alias("hull"), shapes.is_valid(F.col("parts")).alias("valid"), F.size(shapes.boundary(F.col("parts"))[0]).cast("bigint").alias("corners"))), f"WITH {_LOTS} SELECT id, round((r - l) * (t - b), 6) AS area, round(2 * (r - l + t - b), 6) AS perimeter, round((l + r) / 2, 6) AS cx, round((r - l) * (t - b), 6) AS box, round((r - l) * (t - b), 6) AS hull, true AS valid, 5::BIGINT AS corners FROM q2")
add("buffer_area", lambda s, d: dealt(lot_parts(s, d)).select("id", F.round(shapes.polygon_area(shapes.buffered(F.col("parts"), 0.5)), 1).alias("area")), f"WITH {_LOTS} SELECT id, round((r - l) * (t - b) + r - l + t - b + 64 * sin(pi() / 32) / 2 * 0.25, 1) AS area FROM q2")
add("simplify", lambda s, d: lot_parts(s, d).select("id", F.flatten(F.transform("parts", lambda r: F.concat(r, F.array(F.struct(r[0]["x"].alias("x"), ((r[0]["y"] + r[3]["y"]) / 2).alias("y")))))).alias("r")).select("id", F.size(shapes.simplify(F.array("r"), 0.01)[0]).cast("bigint").alias("corners")), "SELECT s_suppkey AS id, 4::BIGINT AS corners FROM supplier")
_PTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_DELAUNAY = f"""{_PTS}, ab AS (SELECT a.id AS focal, b.id AS neighbor, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 AS h FROM p a JOIN p b ON a.id < b.id),
s AS (SELECT focal, neighbor, (c.x - mx) * nx + (c.y - my) * ny AS s, (c.x - mx) ** 2 + (c.y - my) ** 2 - h AS g FROM ab JOIN p c ON c.id <> focal AND c.id <> neighbor),
one AS (SELECT focal, neighbor FROM s GROUP BY 1, 2 HAVING coalesce(max(g / s) FILTER (s < 0), -1e300) <= coalesce(min(g / s) FILTER (s > 0), 1e300) AND coalesce(min(g) FILTER (s = 0), 0) >= 0),
e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM one UNION ALL SELECT neighbor, focal, 1 FROM one)"""
add("delaunay", lambda s, d: edges(triangulation.triangulation(EMB(s, d))), f"WITH {_DELAUNAY} SELECT focal, neighbor, weight FROM e0")
add("convex_hull", lambda s, d: rounded(triangulation.convex_hull(supplier(s, d)).select("x", "y")), f"""WITH {P}, u AS (SELECT DISTINCT x, y FROM p), e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS cy FROM u a JOIN u b ON a.x <> b.x OR a.y <> b.y
WHERE NOT EXISTS (SELECT 1 FROM u c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (c.x - b.x) > 0 OR (c.y - a.y) * (c.y - b.y) > 0))))
SELECT DISTINCT round(x, 6) + 0 AS x, y FROM (SELECT ax AS x, ay AS y FROM e UNION ALL SELECT bx, cy FROM e)""")

# columns of geometry, over customers
XY = lambda s, d: CUST(s, d).select("id", F.struct((F.col("x") / 1000).alias("x"), F.col("y")).alias("p"))
_XY = "c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer)"
pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
p_ = lambda: F.col("p")
_COLUMNS = {
    "angle_between": (lambda: geo.angle_between(pt(0, 0), pt(1, 0), p_()), "atan2(y, x)"),
    "is_collinear": (lambda: geo.is_collinear(pt(0, 0), pt(1, 1), F.struct(p_()["y"].alias("x"), F.floor(p_()["y"] / 2 + F.lit(6)).cast("double").alias("y"))), "floor(y / 2 + 6) = y"),
    "orientation": (lambda: geo.orientation(pt(0, 0), pt(2, 1), p_()), "2 * y - x"),
    "segment_turn": (lambda: geo.segment_turn(pt(0, 0), pt(2, 1), p_()).cast("bigint"), "sign(2 * y - x)::BIGINT"),
    "touches_rectangle": (lambda: geo.touches_rectangle(p_(), geo.rectangle(F.lit(1.0), F.lit(3.0), F.lit(6.0), F.lit(12.0))).cast("bigint"), "(x BETWEEN 1 AND 6 AND y BETWEEN 3 AND 12)::BIGINT"),
    "point_at": (lambda: geo.point_at(pt(0, 0), pt(1, 0), p_()["x"], p_()["y"])["x"], "y * cos(x)"),
    "segments_meet_x": (lambda: geo.segments_intersection(pt(0, 12), pt(10, 12), F.struct(p_()["x"].alias("x"), F.lit(0.0).alias("y")), F.struct(p_()["x"].alias("x"), p_()["y"].alias("y")))["x"], "CASE WHEN x BETWEEN 0 AND 10 AND y >= 12 THEN x END"),
    "ray_meets_y": (lambda: geo.ray_segment_intersection(pt(0, 0), F.struct(F.lit(1.0).alias("x"), p_()["y"].alias("y")), pt(2, -1000), pt(2, 1000))["y"], "2 * y"),
    "point_on_segment": (lambda: geo.point_on_segment(pt(0, 3), pt(0, 9), F.struct(F.lit(0.0).alias("x"), p_()["y"].alias("y")))["y"], "CASE WHEN y BETWEEN 3 AND 9 THEN y END"),
    "line_y": (lambda: geo.line_y(geo.line(F.lit(2.0), F.lit(1.0)), p_()["x"]), "2 * x + 1"),
    "line_x": (lambda: geo.line_x(geo.line(p_()["y"], F.lit(1.0)), F.lit(4.0)), "3 / nullif(y, 0)"),
    "segment_slope": (lambda: geo.segment_line(pt(0, 0), p_())["m"], "y / nullif(x, 0)"),
    "box_common": (lambda: geo.bbox_overlap(geo.rectangle(F.lit(1.0), F.lit(3.0), F.lit(6.0), F.lit(12.0)), geo.rectangle(p_()["x"], p_()["y"], p_()["x"] + 1, p_()["y"] + 1)), "x <= 6 AND x + 1 >= 1 AND y <= 12 AND y + 1 >= 3"),
    "box_intersection": (lambda: geo.rectangle_intersection(geo.rectangle(F.lit(1.0), F.lit(3.0), F.lit(6.0), F.lit(12.0)), geo.rectangle(p_()["x"], p_()["y"], p_()["x"] + 1, p_()["y"] + 1))["kind"], "CASE WHEN x > 6 OR x + 1 < 1 OR y > 12 OR y + 1 < 3 THEN NULL WHEN (x = 6 OR x + 1 = 1) AND (y = 12 OR y + 1 = 3) THEN 'point' WHEN x = 6 OR x + 1 = 1 OR y = 12 OR y + 1 = 3 THEN 'segment' ELSE 'rectangle' END"),
    "box_scaled_left": (lambda: geo.scaled(geo.rectangle(p_()["x"], p_()["y"], p_()["x"] + 2, p_()["y"] + 4), F.lit(3.0))["left"], "x - 2"),
    "box_moved_upper": (lambda: geo.moved_to(geo.rectangle(p_()["x"], p_()["y"], p_()["x"] + 2, p_()["y"] + 4), pt(0, 0))["upper"], "2::DOUBLE"),
    "chain_length": (lambda: geo.chain_length(F.array(pt(0, 0), F.struct(p_()["x"].alias("x"), F.lit(0.0).alias("y")), p_())), "abs(x) + y"),
    "is_clockwise": (lambda: geo.is_clockwise(F.array(pt(0, 0), pt(0, 1), F.struct(p_()["x"].alias("x"), F.lit(0.5).alias("y")))), "x > 0"),
    "ccw": (lambda: geo.ccw(F.array(pt(0, 0), pt(0, 1), F.struct(p_()["x"].alias("x"), F.lit(0.5).alias("y")))), "x <= 0"),
    "box_of_ring": (lambda: geo.bbox(F.array(pt(0, 0), p_(), pt(1, 30)))["right"], "greatest(1, x)"),
    "circumradius": (lambda: geo.circumradius(pt(0, 0), F.struct((p_()["y"] + 1).alias("x"), F.lit(0.0).alias("y")), pt(0, 2)), "sqrt((y + 1) ** 2 + 4) / 2"),
    "swapped_lonlat": (lambda: geo.lonlat(F.array(p_()))[0]["x"], "y"),
    "geojson_x": (lambda: geo.from_geojson(F.format_string('{"type":"Point","coordinates":[%s,%s]}', p_()["x"].cast("string"), p_()["y"].cast("string")))[0][0]["x"], "x"),
    "arc_to_linear": (lambda: sphere.arc_to_linear(p_()["y"] * 100), "sqrt(2 - 2 * cos(y * 100 / 6371))"),
    "linear_to_arc": (lambda: sphere.linear_to_arc(p_()["y"] / 20), "6371 * acos(1 - (y / 20) ** 2 / 2)"),
    "lnglat_of_xyz": (lambda: F.degrees(sphere.to_lnglat(sphere.to_xyz(p_()["x"] * 10, p_()["y"]))["lon"]), "x * 10"),
    "shape_len": (lambda: geo.shape_attributes(F.array(pt(0, 0), p_(), pt(1, 30)))["len"].cast("bigint"), "3::BIGINT"),
}
for _k, (_f, _x) in _COLUMNS.items():
    add(f"geo_{_k}", lambda s, d, f=_f: rounded(XY(s, d).select("id", f().alias("v"))), f"WITH {_XY}, v AS (SELECT id, {_x} AS v FROM c) SELECT id, {'v' if _k in ('is_collinear', 'segment_turn', 'touches_rectangle', 'box_common', 'box_intersection', 'is_clockwise', 'ccw', 'shape_len') else 'round(v::DOUBLE, 6) + 0 AS v'} FROM v")
add("geogrid", lambda s, d: sphere.geogrid(s, (0.0, 40.0), (20.0, 0.0), _t(s, d, "supplier").count()).filter("j = 0").select("i", F.round("lat", 4).alias("lat")), "SELECT i::INT AS i, round(40 - 40 * i::DOUBLE / n, 4) AS lat FROM (SELECT count(*) AS n FROM supplier), range((SELECT count(*) + 1 FROM supplier)) t(i)")

# flows that grow with the tables: an order leads from its customer to another one
ORDERS = lambda s, d: _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("o"), (F.col("o_orderkey") * 7919 % 15013).alias("d"))
_ORDERS = "f AS (SELECT o_orderkey AS id, o_custkey AS o, o_orderkey * 7919 % 15013 AS d FROM orders), n AS (SELECT id FROM f)"
add("netw_orders_c", lambda s, d: edges(builders.net_weights(ORDERS(s, d), "C")), f"WITH {_ORDERS}, e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM f a JOIN f b ON a.d = b.o AND a.id <> b.id), {FULL()} {OUT}")
add("netw_orders_o_degrees", lambda s, d: rounded(builders.net_weights(ORDERS(s, d), "O").cardinalities()), f"WITH {_ORDERS} SELECT id, count(*) OVER (PARTITION BY o) - 1 AS cardinality FROM f")

# rasters
RASTER = lambda s, d: _t(s, d, "part").select(F.expr("(p_partkey - 1) div 40").alias("row"), ((F.col("p_partkey") - 1) % 40).alias("col"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(-1.0).alias("value"))
_RASTER = "r AS (SELECT (p_partkey - 1) // 40 AS row, (p_partkey - 1) % 40 AS col, CASE WHEN p_size > 25 THEN p_retailprice ELSE -1 END AS value FROM part)"
add("raster_cells", lambda s, d: rounded(builders.raster_cells(RASTER(s, d), nodata=-1.0)), f"WITH {_RASTER} SELECT row * (max(col) OVER () + 1) + col AS id, row, col, round(value, 6) AS value FROM r QUALIFY value <> -1")


def gridded(s, d):
    """Places are told apart by row and column: the numbers of cells repeat where columns are negative, and several parts may lie at
    one place, where each counts as a neighbor and has the neighbors' sum. A place alone has 0, whatever its own value."""
    c = builders.raster_cells(RASTER(s, d), nodata=-1.0).groupBy("row", "col").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("id", F.struct("row", "col"))
    g = builders.raster_contiguity(c, rook=True)
    alone = g.edges.filter("focal = neighbor").select(F.col("focal").alias("id"), F.lit(True).alias("alone"))
    lag = g.lag(c.select("id", F.col("value").alias("y"))).join(c.select("id", "n"), "id").join(alone, "id", "left")
    grid = g.to_grid(c, lag.select("id", F.when(F.col("alone"), 0.0).otherwise(F.col("lag") * F.col("n")).alias("y")), -1.0)
    v = F.col("value")  # rounded as SQL does, by the product with a million
    return grid.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), (F.when(F.abs(v) < 1e302, F.round(v * 1e6) / 1e6).otherwise(v) + 0.0).alias("value"))


add("raster_lag_grid", gridded, f"WITH {_RASTER}, k AS (SELECT * FROM r WHERE value <> -1), b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM k), f AS (SELECT row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM b)), l AS (SELECT a.row, a.col, coalesce(sum(x.value), 0) AS v FROM k a LEFT JOIN k x ON abs(a.row - x.row) + abs(a.col - x.col) = 1 GROUP BY 1, 2) SELECT f.row, f.col, round(coalesce(v, -1), 6) AS value FROM f LEFT JOIN l ON f.row = l.row AND f.col = l.col")
add("lattice_polygons", lambda s, d: rounded(builders.lattice_polygons(s, 4, _t(s, d, "supplier").count()).select("id", geo.bbox(F.col("parts")[0])["left"].alias("x"), geo.bbox(F.col("parts")[0])["lower"].alias("y"))), "SELECT a.i * n + b.i AS id, b.i::DOUBLE AS x, a.i::DOUBLE AS y FROM range(4) a(i), (SELECT count(*) AS n FROM supplier), range((SELECT count(*) FROM supplier)) b(i)")
add("made_up_raster", lambda s, d: builders.test_raster(s, 3, 8, _t(s, d, "supplier").count()).groupBy("layer").agg(F.count(F.lit(1)).alias("cells")).select(F.col("layer").cast("bigint").alias("layer"), "cells"), "SELECT i AS layer, 8 * count(*) AS cells FROM supplier, range(3) t(i) GROUP BY i")
