"""Query catalogue over the driver's tables: name -> (plan, SQL). Floats are rounded to 6 decimals in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import sphere
from ..operators import builders, matching, polygons, triangulation
from ..operators.graph import Graph
from ..operators.joins import sphere_knn_join

BAND, K = 400.0, 4


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier(spark, sf):
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))


def customer(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", "c_nationkey")


def nation_blocks(spark, sf):
    return builders.block_contiguity(_t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("regime")))


def supplier_blocks(spark, sf):
    return builders.block_contiguity(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("regime")))


def band(spark, sf):
    return builders.distance_band(supplier(spark, sf), BAND)


def knn(spark, sf):
    return builders.knn(supplier(spark, sf), K)


def inverse(spark, sf):
    return builders.distance_band(supplier(spark, sf), BAND, binary=False)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, whole numbers to bigint."""
    out = []
    for c, kind in df.dtypes:
        if kind == "double":
            out.append((F.round(F.col(c), 6) + F.lit(0.0)).alias(c))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


def edges(g: Graph) -> DataFrame:
    return rounded(g.edges)


def rounded_pairs(df: DataFrame, value: str) -> DataFrame:
    """As ``rounded`` for one column of values that aren't negative, for results of billions of rows: by SQL's arithmetic, since
    ``round`` makes a decimal of each. From 2 ** 52 millionths on there is nothing to round."""
    v = F.col(value)
    return df.withColumn(value, F.when(v < 4e9, F.floor(v * 1e6 + 0.5) / 1e6).when(v < 1e302, v * 1e6 / 1e6).otherwise(v))


P = "p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier)"
N = "n AS (SELECT id FROM p)"
DIST = "d AS (SELECT a.id AS focal, b.id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id <> b.id)"
BANDED = f"{P}, {N}, {DIST}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM d WHERE d <= {BAND})"
KNN = f"{P}, {N}, {DIST}, k0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d, neighbor) AS r FROM d) WHERE r <= {K})"
FULL = lambda e="e0", out="e", n="n": f"{out} AS (SELECT * FROM {e} UNION ALL SELECT id, id, 0::DOUBLE FROM {n} WHERE id NOT IN (SELECT focal FROM {e}))"
OUT = "SELECT focal, neighbor, round(weight, 6) + 0 AS weight FROM e"
INV = BANDED.replace("1::DOUBLE AS weight FROM d WHERE", "CASE WHEN d = 0 THEN 0 ELSE 1 / nullif(d, 0) END AS weight FROM d WHERE")
BLOCKS = "n AS (SELECT s_suppkey AS id FROM supplier), e0 AS (SELECT a.s_suppkey AS focal, b.s_suppkey AS neighbor, 1::DOUBLE AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)"

CATALOG: dict[str, tuple] = {}


def add(name: str, plan, sql: str | None = None) -> None:
    CATALOG[name] = (plan, sql)


def lagged(spark, sf):
    c = customer(spark, sf)
    g = builders.block_contiguity(c.select("id", F.col("c_nationkey").alias("regime"))).transform("R")
    return rounded(g.lag(c.select("id", F.col("c_acctbal").alias("y"))))


add("block_lag_rowstd", lagged, "SELECT c_custkey AS id, round(CASE WHEN count(*) OVER w > 1 THEN (sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1) ELSE 0 END, 6) + 0 AS lag FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
add("block_lag_pairs", lambda s, d: rounded(Graph(supplier_blocks(s, d).edges, supplier(s, d)).transform("R").lag(supplier(s, d).select("id", F.col("x").alias("y")))), f"WITH {BLOCKS}, e AS (SELECT focal, neighbor, weight / sum(weight) OVER (PARTITION BY focal) AS weight FROM e0) SELECT id, round(coalesce(sum(weight * s_acctbal), 0), 6) + 0 AS lag FROM n LEFT JOIN e ON id = focal LEFT JOIN supplier ON neighbor = s_suppkey GROUP BY id")
add("block_contiguity", lambda s, d: edges(nation_blocks(s, d)), "SELECT a.n_nationkey::BIGINT AS focal, b.n_nationkey::BIGINT AS neighbor, 1::DOUBLE AS weight FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
add("distance_band_binary", lambda s, d: edges(band(s, d)), f"WITH {BANDED}, {FULL()} {OUT}")
add("distance_band_inverse", lambda s, d: edges(inverse(s, d)), f"WITH {INV}, {FULL()} {OUT}")
add("knn_4", lambda s, d: edges(knn(s, d)), f"WITH {KNN}, {FULL('k0')} {OUT}")
TRANSFORMS = {
    "r": "coalesce(weight / nullif(sum(weight) OVER (PARTITION BY focal), 0), 0)",
    "d": "weight / (SELECT sum(weight) FROM e1)",
    "b": "(weight <> 0)::INT::DOUBLE",
}
for _k, _x in TRANSFORMS.items():
    add(f"transform_{_k}", lambda s, d, k=_k: edges(inverse(s, d).transform(k)), f"WITH {INV}, {FULL(out='e1')}, e AS (SELECT focal, neighbor, {_x} AS weight FROM e1) {OUT}")
add("transform_v", lambda s, d: edges(inverse(s, d).transform("V")), f"WITH {INV}, {FULL(out='e1')}, v AS (SELECT focal, neighbor, coalesce(weight / nullif(sqrt(sum(weight * weight) OVER (PARTITION BY focal)), 0), 0) AS s FROM e1), e AS (SELECT focal, neighbor, s * (SELECT count(*) FROM n) / (SELECT sum(s) FROM v) AS weight FROM v) {OUT}")

_z = f"least(1, abs(d) / {BAND})"
KERNEL_SQL = {
    "triangular": f"1 - {_z}", "parabolic": f"0.75 * (1 - {_z} * {_z})", "gaussian": f"exp(-(d / {BAND}) * (d / {BAND}) / 2) / sqrt(2 * pi())",
    "bisquare": f"15::DOUBLE / 16 * (1 - {_z} * {_z}) ** 2", "tricube": f"70::DOUBLE / 81 * (1 - {_z} ** 3) ** 3", "cosine": f"pi() / 4 * cos(pi() / 2 * {_z})",
    "exponential": f"exp(-d / {BAND})", "boxcar": f"(d < {BAND})::INT::DOUBLE", "identity": "d",
}
for _k, _x in KERNEL_SQL.items():
    add(f"kernel_{_k}", lambda s, d, k=_k: edges(builders.kernel(supplier(s, d), k, bandwidth=BAND)), f"WITH {BANDED.replace('1::DOUBLE AS weight FROM d WHERE', f'({_x})::DOUBLE AS weight FROM d WHERE')}, {FULL()} {OUT}")
add("kernel_default_bandwidth", lambda s, d: rounded_pairs(builders.kernel(supplier(s, d), zeros=True).edges, "weight"), f"WITH {P}, {N}, {DIST}, h AS (SELECT quantile_cont(d, 0.25) AS h FROM d), e0 AS (SELECT focal, neighbor, CASE WHEN d > h THEN 0 ELSE exp(-(d / h) * (d / h) / 2) / sqrt(2 * pi()) END AS weight FROM d, h), {FULL()} {OUT}")
add("kernel_knn", lambda s, d: edges(builders.kernel(supplier(s, d), "triangular", k=K)), f"WITH {KNN}, k1 AS (SELECT focal, neighbor, d FROM k0 JOIN d USING (focal, neighbor)), h AS (SELECT max(d) AS h FROM k1), e AS (SELECT focal, neighbor, 1 - d / h AS weight FROM k1, h) {OUT}")
add("kernel_knn_adaptive", lambda s, d: edges(builders.adaptive_kernel(supplier(s, d), K)), f"WITH {KNN}, k1 AS (SELECT focal, neighbor, d FROM k0 JOIN d USING (focal, neighbor)), h AS (SELECT focal, max(d) * 1.0000001 AS h FROM k1 GROUP BY focal), a AS (SELECT * FROM k1 UNION ALL SELECT id, id, 0 FROM n), e AS (SELECT focal, neighbor, 1 - coalesce(d / nullif(h, 0), 0) AS weight FROM a JOIN h USING (focal)) {OUT}")
EMB = lambda s, d: _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
add("knn_embeddings", lambda s, d: edges(builders.knn(EMB(s, d), 3)), "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), d AS (SELECT a.id AS focal, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM p a JOIN p b ON a.id <> b.id) SELECT focal, neighbor, 1::DOUBLE AS weight FROM d WHERE r <= 3")
add("min_threshold_distance", lambda s, d: rounded(builders.min_threshold_distance(supplier(s, d))), f"WITH {P}, {DIST} SELECT round(max(m), 6) AS threshold FROM (SELECT min(d) AS m FROM d GROUP BY focal)")
add("knn_coplanar_clique", lambda s, d: rounded_pairs(builders.knn(_t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 20).cast("double").alias("y")), 2, coplanar="clique").edges, "weight"), """
WITH q AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, floor(p_retailprice / 20)::DOUBLE AS y FROM part), m AS (SELECT *, min(id) OVER (PARTITION BY x, y) AS rep FROM q),
r AS (SELECT * FROM m WHERE id = rep), d AS (SELECT a.id AS focal, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS k FROM r a JOIN r b ON a.id <> b.id)
SELECT f.id AS focal, n.id AS neighbor, 1::DOUBLE AS weight FROM d JOIN m f ON d.focal = f.rep JOIN m n ON d.neighbor = n.rep WHERE k <= 2 UNION ALL SELECT a.id, b.id, 1::DOUBLE FROM m a JOIN m b ON a.rep = b.rep AND a.id <> b.id""")

_GRID = "k AS (SELECT count(*) AS n FROM supplier), g AS (SELECT a.i * n + b.i AS id, a.i AS r, b.i AS c FROM range(5) a(i), k, range((SELECT count(*) FROM supplier)) b(i))"
for _k, _x in {
    "rook": "abs(a.r - b.r) + abs(a.c - b.c) = 1", "queen": "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1", "bishop": "abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1",
    "hex": "(abs(a.r - b.r) + abs(a.c - b.c) = 1 OR (abs(a.c - b.c) = 1 AND b.r - a.r = CASE WHEN a.c % 2 = 1 THEN 1 ELSE -1 END))",
}.items():
    add(f"lattice_{_k}", lambda s, d, k=_k: edges(builders.lattice(s, 5, _t(s, d, "supplier").count(), k)), f"WITH {_GRID} SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM g a JOIN g b ON {_x}")
CELLS = lambda s, d: _t(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"))
_CELLS = "c AS (SELECT p_partkey AS id, p_partkey // 50 AS r, p_partkey % 50 AS c FROM part WHERE p_size > 10), n AS (SELECT id FROM c)"
add("raster_contiguity", lambda s, d: edges(builders.raster_contiguity(CELLS(s, d))), f"WITH {_CELLS}, e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM c a JOIN c b ON greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1), {FULL()} {OUT}")

add("cardinalities", lambda s, d: rounded(band(s, d).cardinalities()), f"WITH {BANDED} SELECT id, count(focal) AS cardinality FROM n LEFT JOIN e0 ON id = focal GROUP BY id")
add("isolates", lambda s, d: SPARSE(s, d).isolates(), f"WITH {P}, {N}, {DIST} SELECT id FROM n WHERE id NOT IN (SELECT focal FROM d WHERE d <= 15)")
add("card_histogram", lambda s, d: rounded(band(s, d).histogram()), f"WITH {BANDED}, c AS (SELECT id, count(focal) AS k FROM n LEFT JOIN e0 ON id = focal GROUP BY id), h AS (SELECT k, count(*) AS m FROM c GROUP BY k) SELECT v AS cardinality, coalesce(m, 0) AS count FROM (SELECT unnest(range((SELECT min(k) FROM h), (SELECT max(k) + 1 FROM h))) AS v) LEFT JOIN h ON v = k")
add("properties", lambda s, d: rounded(band(s, d).properties()), f"WITH {BANDED}, {FULL()}, c AS (SELECT id, count(focal) AS k FROM n LEFT JOIN e0 ON id = focal GROUP BY id) SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e0) AS n_edges, (SELECT count(*) FROM e0) AS nonzero, round(100.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) ** 2, 6) AS pct_nonzero, (SELECT count(*) FROM c WHERE k = 0) AS n_isolates, (SELECT max(k) FROM c) AS max_neighbors, (SELECT min(k) FROM c) AS min_neighbors, (SELECT round(avg(k), 6) FROM c) AS mean_neighbors")
add("summary_s0_s1_s2", lambda s, d: rounded(knn(s, d).summary()), f"WITH {KNN}, u AS (SELECT focal, neighbor, weight AS w, 0 AS b FROM k0 UNION ALL SELECT neighbor, focal, 0, weight FROM k0), m AS (SELECT focal, neighbor, sum(w) AS w, sum(b) AS b FROM u GROUP BY 1, 2), t AS (SELECT focal, sum(w + b) AS t FROM m GROUP BY focal) SELECT round(sum(w), 6) AS s0, round(sum((w + b) ** 2) / 2, 6) AS s1, round(sum(w * b), 6) AS trace_gg, round(sum(b * b), 6) AS trace_gtg, round(sum(w * b) + sum(b * b), 6) AS trace_gtg_gg, round((SELECT sum(t * t) FROM t), 6) AS s2 FROM m")
add("diagonals", lambda s, d: rounded(inverse(s, d).diagonals()), f"WITH {INV}, a AS (SELECT focal AS id, sum(weight) AS r FROM e0 GROUP BY 1), b AS (SELECT neighbor AS id, sum(weight) AS c, sum(weight * weight) AS q FROM e0 GROUP BY 1), g AS (SELECT x.focal AS id, sum(x.weight * y.weight) AS g FROM e0 x JOIN e0 y ON x.focal = y.neighbor AND x.neighbor = y.focal GROUP BY 1) SELECT id, round(coalesce(g, 0), 6) AS diag_gg, round(coalesce(q, 0), 6) AS diag_gtg, round((coalesce(r, 0) + coalesce(c, 0)) ** 2, 6) AS s2 FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN g USING (id)")
add("asymmetry", lambda s, d: knn(s, d).asymmetry(), f"WITH {KNN} SELECT focal, neighbor FROM k0 WHERE (neighbor, focal) NOT IN (SELECT focal, neighbor FROM k0) UNION ALL SELECT neighbor, focal FROM k0 WHERE (neighbor, focal) NOT IN (SELECT focal, neighbor FROM k0)")
KW = f"{KNN}, w0 AS (SELECT focal, neighbor, (focal % 7 + 1)::DOUBLE AS weight FROM k0)"
weighted = lambda s, d: Graph(knn(s, d).edges.withColumn("weight", (F.col("focal") % 7 + 1).cast("double")), supplier(s, d))
for _k, _x in {"sum": "a.weight + b.weight", "min": "least(a.weight, b.weight)", "max": "greatest(a.weight, b.weight)", "mean": "(a.weight + b.weight) / 2"}.items():
    _pair = f"CASE WHEN a.weight IS NULL THEN b.weight WHEN b.weight IS NULL OR a.weight = b.weight THEN a.weight ELSE {_x} END"
    add(f"make_symmetric_{_k}", lambda s, d, k=_k: edges(weighted(s, d).make_symmetric(reduction=k)), f"WITH {KW}, b0 AS (SELECT neighbor AS focal, focal AS neighbor, weight FROM w0), e AS (SELECT focal, neighbor, {_pair} AS weight FROM w0 a FULL JOIN b0 b USING (focal, neighbor)) {OUT}")
add("make_symmetric_intersection", lambda s, d: edges(knn(s, d).make_symmetric(intersection=True)), f"WITH {KNN}, e0 AS (SELECT * FROM k0 WHERE (neighbor, focal) IN (SELECT focal, neighbor FROM k0)), {FULL()} {OUT}")
BOTH = f"{KNN}, e1 AS (SELECT focal, neighbor FROM d WHERE d <= {BAND})"
for _k, _f, _x in (
    ("union", Graph.union, "SELECT focal, neighbor FROM k0 UNION SELECT * FROM e1"), ("intersection", Graph.intersection, "SELECT focal, neighbor FROM k0 INTERSECT SELECT * FROM e1"),
    ("difference", Graph.difference, "SELECT focal, neighbor FROM k0 EXCEPT SELECT * FROM e1"), ("symdiff", Graph.symmetric_difference, "(SELECT focal, neighbor FROM k0 EXCEPT SELECT * FROM e1) UNION (SELECT * FROM e1 EXCEPT SELECT focal, neighbor FROM k0)"),
):
    add(f"graph_{_k}", lambda s, d, f=_f: edges(f(knn(s, d), band(s, d))), f"WITH {BOTH}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM ({_x})), {FULL()} {OUT}")
add("graph_clip", lambda s, d: edges(inverse(s, d).clip(knn(s, d))), f"WITH {INV}, k0 AS (SELECT focal, neighbor FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d, neighbor) AS r FROM d) WHERE r <= {K}), c0 AS (SELECT e0.* FROM e0 JOIN k0 USING (focal, neighbor)), {FULL('c0')} {OUT}")
add("subgraph", lambda s, d: edges(band(s, d).subgraph(supplier(s, d).filter("x > 0"))), f"WITH {BANDED}, s AS (SELECT id FROM p WHERE x > 0), s0 AS (SELECT * FROM e0 WHERE focal IN (SELECT id FROM s) AND neighbor IN (SELECT id FROM s)), {FULL('s0', n='s')} {OUT}")
add("self_weight", lambda s, d: edges(band(s, d).assign_self_weight(2.0)), f"WITH {BANDED}, e AS (SELECT * FROM e0 UNION ALL SELECT id, id, 2 FROM n) {OUT}")
add("eliminate_zeros", lambda s, d: edges(builders.kernel(supplier(s, d), "boxcar", bandwidth=BAND).eliminate_zeros()), f"WITH {BANDED.replace('d <= ', 'd < ')}, {FULL()} {OUT}")
_W2 = "w2 AS (SELECT DISTINCT a.focal, b.neighbor FROM k0 a JOIN k0 b ON a.neighbor = b.focal)"
add("higher_order_2", lambda s, d: edges(knn(s, d).higher_order(2)), f"WITH {KNN}, {_W2}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM w2 WHERE focal <> neighbor AND (focal, neighbor) NOT IN (SELECT focal, neighbor FROM k0)), {FULL()} {OUT}")
add("lower_order_2", lambda s, d: edges(knn(s, d).higher_order(2, lower_order=True)), f"WITH {KNN}, {_W2}, e AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM (SELECT * FROM w2 UNION SELECT focal, neighbor FROM k0) WHERE focal <> neighbor) {OUT}")
add("order_kmax3", lambda s, d: rounded(knn(s, d).order(3)), f"WITH {KNN}, {_W2}, w3 AS (SELECT DISTINCT a.focal, b.neighbor FROM w2 a JOIN k0 b ON a.neighbor = b.focal) SELECT focal, neighbor, min(h)::BIGINT AS hops FROM (SELECT focal, neighbor, 1 AS h FROM k0 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3) WHERE focal <> neighbor GROUP BY 1, 2")
add("shimbel", lambda s, d: rounded(nation_blocks(s, d).union(builders.block_contiguity(_t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") % 7).alias("regime")))).shimbel()), "WITH RECURSIVE k0 AS (SELECT a.n_nationkey::BIGINT AS focal, b.n_nationkey::BIGINT AS neighbor FROM nation a JOIN nation b ON (a.n_regionkey = b.n_regionkey OR a.n_nationkey % 7 = b.n_nationkey % 7) AND a.n_nationkey <> b.n_nationkey), t AS (SELECT focal, neighbor, 1 AS h FROM k0 UNION SELECT t.focal, k0.neighbor, h + 1 FROM t JOIN k0 ON t.neighbor = k0.focal WHERE h < 8) SELECT focal, neighbor, min(h)::BIGINT AS hops FROM t WHERE focal <> neighbor GROUP BY 1, 2")
SPARSE = lambda s, d: builders.distance_band(supplier(s, d), 15.0)
add("components", lambda s, d: SPARSE(s, d).component_labels(), f"WITH RECURSIVE {P}, {DIST}, t AS (SELECT id, id AS o FROM p UNION SELECT t.id, d.neighbor FROM t JOIN d ON t.o = d.focal WHERE d.d <= 15) SELECT id, min(o) AS component FROM t GROUP BY id")
SEG = lambda s, d: _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("g"), F.col("s_nationkey") % 4).alias("y"))
_TALLY = f"WITH {KNN}, m AS (SELECT focal, 'g' || (s_nationkey % 4) AS y, count(*) AS c FROM k0 JOIN supplier ON neighbor = s_suppkey GROUP BY 1, 2)"
add("modal_lag", lambda s, d: knn(s, d).lag(SEG(s, d), ties="lowest"), f"{_TALLY} SELECT focal AS id, y AS lag FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY c DESC, y) AS r FROM m) WHERE r = 1")
add("modal_lag_tryself", lambda s, d: knn(s, d).lag(SEG(s, d), ties="tryself"), f"{_TALLY} SELECT focal AS id, y AS lag FROM (SELECT m.*, row_number() OVER (PARTITION BY focal ORDER BY c DESC, y <> 'g' || (s_nationkey % 4), y) AS r FROM m JOIN supplier ON focal = s_suppkey) WHERE r = 1")
Y = lambda s, d: _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("y"))
add("lag_inverse", lambda s, d: rounded(inverse(s, d).lag(Y(s, d))), f"WITH {INV} SELECT n.id, round(coalesce(sum(weight * y), 0), 6) AS lag FROM n LEFT JOIN e0 ON n.id = focal LEFT JOIN p ON neighbor = p.id GROUP BY n.id")
_STATS = "count(y) AS count, round(avg(y), 6) AS mean, median(y) AS median, round(stddev_samp(y), 6) AS std, min(y) AS min, max(y) AS max, round(sum(y), 6) AS sum, count(DISTINCT y) AS nunique"
_MODE = "(SELECT focal, y AS mode FROM (SELECT focal, y, row_number() OVER (PARTITION BY focal ORDER BY count(*) DESC, y) AS r FROM v GROUP BY focal, y) WHERE r = 1)"
_DESC = f"SELECT n.id, s.* EXCLUDE (focal), mode FROM n LEFT JOIN (SELECT focal, {_STATS} FROM v GROUP BY focal) s ON n.id = s.focal LEFT JOIN {_MODE} m ON n.id = m.focal"
add("describe", lambda s, d: rounded(band(s, d).describe(Y(s, d))), f"WITH {BANDED}, v AS (SELECT focal, y FROM e0 JOIN p ON neighbor = p.id) {_DESC}")
add("describe_percentile_band", lambda s, d: rounded(band(s, d).describe(Y(s, d), q=(25, 75))), f"WITH {BANDED}, v0 AS (SELECT focal, y FROM e0 JOIN p ON neighbor = p.id), q AS (SELECT focal, quantile_cont(y, 0.25) AS lo, quantile_cont(y, 0.75) AS hi, count(*) AS c FROM v0 GROUP BY focal), v AS (SELECT focal, y FROM v0 JOIN q USING (focal) WHERE c <= 2 OR y BETWEEN lo AND hi) {_DESC}")
add("local_clustering", lambda s, d: rounded(knn(s, d).make_symmetric().local_clustering()), f"WITH {KNN}, u AS (SELECT focal, neighbor FROM k0 UNION SELECT neighbor, focal FROM k0), k AS (SELECT focal, count(*) AS k FROM u GROUP BY focal), t AS (SELECT a.focal, count(*) AS t FROM u a JOIN u b ON a.focal = b.focal AND a.neighbor <> b.neighbor JOIN u c ON c.focal = a.neighbor AND c.neighbor = b.neighbor GROUP BY 1) SELECT focal AS id, CASE WHEN k > 1 THEN round(coalesce(t, 0)::DOUBLE / (k * (k - 1)), 6) END AS clustering FROM k LEFT JOIN t USING (focal)")
add("attach_islands", lambda s, d: edges(builders.attach_islands(SPARSE(s, d), supplier(s, d))), f"WITH {P}, {N}, {DIST}, e0 AS (SELECT focal, neighbor, 1::DOUBLE AS weight FROM d WHERE d <= 15), i AS (SELECT focal, neighbor FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d, neighbor) AS r FROM d) WHERE r = 1 AND focal NOT IN (SELECT focal FROM e0)), e AS (SELECT * FROM e0 UNION SELECT focal, neighbor, 1 FROM i UNION SELECT neighbor, focal, 1 FROM i) {OUT}")


def flows(spark, sf):
    """Trade flows between nations: origin and destination of all order lines."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o, d = F.col("s_nationkey").cast("bigint"), F.col("c_nationkey").cast("bigint")
    return ends.select(o.alias("o"), d.alias("d")).distinct().select((F.col("o") * 1000 + F.col("d")).alias("id"), "o", "d")


_FLOWS = "f AS (SELECT DISTINCT s_nationkey::BIGINT * 1000 + c_nationkey AS id, s_nationkey AS o, c_nationkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT id FROM f)"
for _k, _x in {"o": "a.o = b.o", "d": "a.d = b.d", "od": "(a.o = b.o OR a.d = b.d)", "c": "a.d = b.o", "a": "(a.o = b.o OR a.d = b.d OR a.o = b.d OR a.d = b.o)"}.items():
    add(f"netw_{_k}", lambda s, d, k=_k: edges(builders.net_weights(flows(s, d), k)), f"WITH {_FLOWS}, e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM f a JOIN f b ON a.id <> b.id AND {_x}), {FULL()} {OUT}")


def od_kron(s, d):
    n = _t(s, d, "supplier").count()
    g = builders.od_weights(builders.lattice(s, 2, 2), builders.lattice(s, 2, n))
    return rounded(g.edges.select(*[(F.col(c)["o"] * 2 * n + F.col(c)["d"]).alias(c) for c in ("focal", "neighbor")], "weight"))


add("od_kron", od_kron, """
WITH k AS (SELECT count(*) AS n FROM supplier),
g AS (SELECT a.i * 2 + b.i AS id, a.i AS r, b.i AS c FROM range(2) a(i), range(2) b(i)),
h AS (SELECT a.i * n + b.i AS id, a.i AS r, b.i AS c FROM range(2) a(i), k, range((SELECT count(*) FROM supplier)) b(i)),
x AS (SELECT a.id AS f, b.id AS n FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
y AS (SELECT a.id AS f, b.id AS n FROM h a JOIN h b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)
SELECT x.f * 2 * k.n + y.f AS focal, x.n * 2 * k.n + y.n AS neighbor, round(1::DOUBLE / count(*) OVER (PARTITION BY x.f, y.f), 6) AS weight FROM x, y, k""")
add("vecw_band", lambda s, d: edges(builders.vector_weights(supplier(s, d).select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") / 2).alias("dx"), (F.col("y") * 3).alias("dy")), 300.0)), f"WITH {P}, {N}, e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.x / 2 - b.x / 2) ** 2 + (a.y * 3 - b.y * 3) ** 2) <= 300), {FULL()} {OUT}")

LL = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("c_custkey") * 53) % 170 - 85).cast("double").alias("lat"))
_LL = "p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 53) % 170 - 85)::DOUBLE AS lat FROM customer)"
_ANG = "2 * asin(sqrt(least(1, sin(radians(20 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(20)) * sin(radians(10 - lon) / 2) ** 2)))"
to = lambda: (F.lit(10.0), F.lit(20.0))
add("haversine", lambda s, d: rounded(LL(s, d).select("id", sphere.harcdist(F.col("lon"), F.col("lat"), *to()).alias("km"))), f"WITH {_LL} SELECT id, round({_ANG} * 6371, 6) AS km FROM p")
add("arcdist", lambda s, d: LL(s, d).select("id", F.round(sphere.arcdist(F.col("lon"), F.col("lat"), *to()), 4).alias("km")), f"WITH {_LL} SELECT id, round({_ANG} * 6371, 4) AS km FROM p")
add("geointerpolate", lambda s, d: rounded(LL(s, d).select("id", sphere.geointerpolate(F.col("lon"), F.col("lat"), *to(), F.lit(0.3)).alias("p")).select("id", "p.*")), f"WITH {_LL}, a AS (SELECT *, {_ANG} AS d FROM p), k AS (SELECT *, sin(0.7 * d) / sin(d) AS k, sin(0.3 * d) / sin(d) AS j FROM a), v AS (SELECT id, k * cos(radians(lat)) * cos(radians(lon)) + j * cos(radians(20)) * cos(radians(10)) AS x, k * cos(radians(lat)) * sin(radians(lon)) + j * cos(radians(20)) * sin(radians(10)) AS y, k * sin(radians(lat)) + j * sin(radians(20)) AS z FROM k) SELECT id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM v")
add("sphere_band", lambda s, d: edges(builders.sphere_band(LL(s, d), 700.0)), f"WITH {_LL}, n AS (SELECT id FROM p), e0 AS (SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM p a JOIN p b ON a.id <> b.id AND 2 * asin(sqrt(least(1, sin(radians(a.lat - b.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) * 6371 <= 700), {FULL()} {OUT}")


def squares(spark, sf):
    k = F.col("n_nationkey").cast("bigint")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return _t(spark, sf, "nation").select(k.alias("id"), F.array(ring).alias("parts"))


RING = lambda: F.col("parts")[0]
POINT = lambda: F.struct(F.lit(2.5).alias("x"), F.lit(3.25).alias("y"))
_SQ = "q AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y FROM nation)"
add("polygon_measures", lambda s, d: rounded(squares(s, d).select("id", geo.ring_area(RING()).alias("area"), geo.perimeter(RING()).alias("perimeter"), geo.centroid(RING())["x"].alias("cx"), geo.centroid(RING())["y"].alias("cy"), geo.ring_point_dist(RING(), POINT()).alias("dist"))), f"WITH {_SQ} SELECT id, 1::DOUBLE AS area, 4::DOUBLE AS perimeter, x + 0.5 AS cx, y + 0.5 AS cy, round(sqrt(greatest(x - 2.5, 0, 2.5 - x - 1) ** 2 + greatest(y - 3.25, 0, 3.25 - y - 1) ** 2), 6) AS dist FROM q")
add("point_in_polygon", lambda s, d: squares(s, d).filter(geo.contains_point(RING(), POINT())).select("id"), f"WITH {_SQ} SELECT id FROM q WHERE 2.5 BETWEEN x AND x + 1 AND 3.25 BETWEEN y AND y + 1")
_SQE = f"WITH {_SQ} SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM q a JOIN q b ON a.id <> b.id AND "
add("vertex_rook", lambda s, d: edges(builders.contiguity(squares(s, d))), _SQE + "abs(a.x - b.x) + abs(a.y - b.y) = 1")
add("vertex_queen", lambda s, d: edges(builders.contiguity(squares(s, d), rook=False)), _SQE + "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1")
add("perimeter_weights", lambda s, d: edges(builders.contiguity(squares(s, d), by_perimeter=True)), _SQE + "abs(a.x - b.x) + abs(a.y - b.y) = 1")
add("box_contiguity", lambda s, d: edges(builders.box_contiguity(squares(s, d), buffer=0.6)), _SQE + "greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 2")
add("travel_cost", lambda s, d: edges(builders.travel_cost(_t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_nationkey").cast("bigint").alias("node")), builders.lattice(s, 5, 5).edges.filter("focal < neighbor").select(F.col("focal").alias("u"), F.col("neighbor").alias("v"), F.lit(1.5).alias("cost")), 3.0)), f"WITH {_SQ} SELECT a.id AS focal, b.id AS neighbor, 1.5::DOUBLE * (abs(a.x - b.x) + abs(a.y - b.y)) AS weight FROM q a JOIN q b ON a.id <> b.id AND abs(a.x - b.x) + abs(a.y - b.y) <= 2")
add("gabriel", lambda s, d: edges(triangulation.triangulation(EMB(s, d), "gabriel")), "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM p a JOIN p b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id <> a.id AND c.id <> b.id AND (a.x - c.x) ** 2 + (a.y - c.y) ** 2 + (b.x - c.x) ** 2 + (b.y - c.y) ** 2 < (a.x - b.x) ** 2 + (a.y - b.y) ** 2)")
add("relative_neighborhood", lambda s, d: edges(triangulation.triangulation(EMB(s, d), "relative_neighborhood")), "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.id AS focal, b.id AS neighbor, 1::DOUBLE AS weight FROM p a JOIN p b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id <> a.id AND c.id <> b.id AND greatest((a.x - c.x) ** 2 + (a.y - c.y) ** 2, (b.x - c.x) ** 2 + (b.y - c.y) ** 2) <= (a.x - b.x) ** 2 + (a.y - b.y) ** 2)")


add("strict_rook", lambda s, d: edges(polygons.strict_contiguity(squares(s, d))), _SQE + "abs(a.x - b.x) + abs(a.y - b.y) = 1")
add("strict_queen", lambda s, d: edges(polygons.strict_contiguity(squares(s, d), rook=False)), _SQE + "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1")
IN = lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 37, F.lit(700)) / 100).alias("x"), (F.pmod(F.col("c_custkey") * 53, F.lit(600)) / 100).alias("y"))
add("points_in_polygons", lambda s, d: polygons.points_in_polygons(IN(s, d), squares(s, d)), f"WITH {_SQ}, c AS (SELECT c_custkey AS id, ((c_custkey * 37) % 700) / 100::DOUBLE AS px, ((c_custkey * 53) % 600) / 100::DOUBLE AS py FROM customer) SELECT c.id, q.id AS polygon_id FROM c JOIN q ON px BETWEEN x AND x + 1 AND py BETWEEN y AND y + 1")
add("dissolve_sides", lambda s, d: rounded(polygons.dissolve_sides(squares(s, d).withColumn("g", F.col("id") % 5), "g").groupBy("group").agg(F.count(F.lit(1)).alias("sides"), F.sum(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("length"))), """
WITH q AS (SELECT n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_nationkey::BIGINT % 5 AS g FROM nation), e AS (SELECT g, x, y, 0 AS v FROM q UNION ALL SELECT g, x, y + 1, 0 FROM q UNION ALL SELECT g, x, y, 1 FROM q UNION ALL SELECT g, x + 1, y, 1 FROM q)
SELECT g AS "group", count(*) AS sides, count(*)::DOUBLE AS length FROM (SELECT g, x, y, v FROM e GROUP BY ALL HAVING count(*) = 1) GROUP BY g""")
add("sphere_knn", lambda s, d: sphere_knn_join(LL(s, d), 2).select("focal", F.round("distance", 3).alias("distance")), f"WITH {_LL}, d AS (SELECT a.id AS focal, 2 * asin(sqrt(least(1, sin(radians(a.lat - b.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) * 6371 AS d FROM p a JOIN p b ON a.id <> b.id) SELECT focal, round(d, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY d) AS r FROM d) WHERE r <= 2")
add("voronoi_total_area", lambda s, d: rounded(polygons.voronoi_cells(EMB(s, d)).agg(F.count(F.lit(1)).alias("cells"), F.sum(geo.ring_area(F.col("parts")[0])).alias("area"))), "WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT count(*) AS cells, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area FROM p")
DEPOTS = lambda s, d: _t(s, d, "region").select((-1 - F.col("r_regionkey")).cast("bigint").alias("id"), (F.col("r_regionkey") * 2000.0).alias("x"), (F.col("r_regionkey") * 5.0).alias("y"))
add("spatial_matches", lambda s, d: edges(matching.spatial_matches(DEPOTS(s, d), supplier(s, d))), f"""
WITH {P}, q AS (SELECT -1 - r_regionkey::BIGINT AS id, r_regionkey * 2000.0::DOUBLE AS x, r_regionkey * 5.0::DOUBLE AS y FROM region),
c AS (SELECT * FROM (SELECT q.id AS depot, p.id, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d, row_number() OVER (PARTITION BY q.id ORDER BY (q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS r FROM q, p) WHERE r <= 5),
m AS (SELECT a.id AS i1, b.id AS i2, e.id AS i3, f.id AS i4, g.id AS i5 FROM c a JOIN c b ON b.depot = -2 AND b.id <> a.id JOIN c e ON e.depot = -3 AND e.id NOT IN (a.id, b.id) JOIN c f ON f.depot = -4 AND f.id NOT IN (a.id, b.id, e.id)
  JOIN c g ON g.depot = -5 AND g.id NOT IN (a.id, b.id, e.id, f.id) WHERE a.depot = -1 ORDER BY a.d + b.d + e.d + f.d + g.d LIMIT 1),
n AS (SELECT id FROM p UNION ALL SELECT id FROM q), e0 AS (SELECT unnest([-1, -2, -3, -4, -5])::BIGINT AS focal, unnest([i1, i2, i3, i4, i5]) AS neighbor, 1::DOUBLE AS weight FROM m), {FULL()} {OUT}""")


def queries() -> dict:
    from . import extra, more, relations, scale, triangles  # noqa: F401  add their own

    return {name: plan for name, (plan, _) in CATALOG.items()}


def sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return {name: text for name, (_, text) in CATALOG.items() if text}
