"""Queries of readers, writers and the older weights surface over tables that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import builders, shapes, weights
from ..sources import binary, tables
from .more import _LOTS, _file, lot_parts
from .queries import BANDED, DIST, P, _t, add, band, rounded, supplier


def wkt_lots(spark, sf):
    """Lots written as text and read again."""
    path = _file(spark, "wkt")
    text = lot_parts(spark, sf).select(binary.to_wkt(F.lit("polygon"), F.col("parts")).alias("value"))
    text.write.text(path)
    box = geo.bbox(F.col("parts")[0])
    return rounded(binary.read_wkt(spark, path).select("kind", shapes.polygon_area(F.col("parts")).alias("area"), box["left"].alias("left"), box["lower"].alias("lower")))


add("file_wkt", wkt_lots, f"""WITH {_LOTS} SELECT 'polygon' AS kind, round((r - l) * (t - b), 6) AS area, round(l, 6) AS "left", round(b, 6) AS lower FROM q2""")


def dbf_suppliers(spark, sf):
    path = _file(spark, "dbf")
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("KEY"), F.col("s_nationkey").cast("bigint").alias("NATION"), F.col("s_name").alias("NAME"))
    binary.write_dbf(rows, path, "KEY")
    return binary.read_dbf(spark, path)


def dbf_joined(spark, sf):
    """A dBase table of suppliers joined to one of parts' sizes by key."""
    path = _file(spark, "dbf")
    binary.write_dbf(_t(spark, sf, "part").select(F.col("p_partkey").alias("PART"), F.col("p_size").cast("bigint").alias("SIZE")), path, "PART")
    both = binary.dbf_join(dbf_suppliers(spark, sf), binary.read_dbf(spark, path), "KEY", "PART")
    return both.select(F.col("KEY").cast("bigint").alias("key"), F.trim("NAME").alias("name"), F.col("SIZE").cast("bigint").alias("size"))


add("dbf_join", dbf_joined, "SELECT s_suppkey AS key, s_name AS name, p_size::BIGINT AS size FROM supplier JOIN part ON s_suppkey = p_partkey")
add(
    "dbf_dups",
    lambda s, d: binary.duplicates(dbf_suppliers(s, d), "NATION").select(F.col("NATION").cast("bigint").alias("nation"), F.col("count").alias("n")),
    "SELECT s_nationkey::BIGINT AS nation, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1",
)


def shp_suppliers(spark, sf):
    path = _file(spark, "shp")
    at = F.array(F.array(F.struct("x", "y")))
    binary.write_shp(supplier(spark, sf).select(F.col("id").alias("record"), F.lit("point").alias("kind"), at.alias("parts")), path)
    return path


add("shp_points", lambda s, d: rounded(binary.points_of(s, shp_suppliers(s, d)).select("x", "y")), "SELECT round(s_acctbal, 6) AS x, round(s_nationkey::DOUBLE, 6) AS y FROM supplier")
add(
    "shp_min_threshold",
    lambda s, d: rounded(binary.min_threshold_of(s, shp_suppliers(s, d))),
    f"WITH {P}, {DIST} SELECT round(max(m), 6) AS threshold FROM (SELECT min(d) AS m FROM d GROUP BY focal)",
)


def gaps(spark, sf):
    """Differences of the balances at both ends of each link."""
    held = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("y"))
    return rounded(weights.adjlist_map(band(spark, sf).links(), held, {"gap": (lambda a, b: b - a, ("y",))}).select("focal", "neighbor", "gap"))


add("adjlist_map", gaps, f"WITH {BANDED} SELECT focal, neighbor, round(b.x - a.x, 6) + 0 AS gap FROM e0 JOIN p a ON a.id = focal JOIN p b ON b.id = neighbor")


def jittered(spark, sf):
    """Parts at shared places, moved apart: each still has its k neighbors."""
    at = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 20).cast("double").alias("y"))
    links = builders.knn(at, 3, coplanar="jitter").links()
    return links.groupBy("focal").agg(F.count_distinct("neighbor").alias("neighbors"), F.count_if(F.col("focal") == F.col("neighbor")).alias("loops"))


add("knn_jitter", jittered, "SELECT p_partkey AS focal, 3::BIGINT AS neighbors, 0::BIGINT AS loops FROM part")
add(
    "column_metadata",
    lambda s, d: (lambda t: t.select(F.col("s_suppkey").alias("id"), F.lit(t.schema["s_acctbal"].metadata["unit"]).alias("unit")))(tables.with_metadata(_t(s, d, "supplier"), "s_acctbal", unit="dollars")),
    "SELECT s_suppkey AS id, 'dollars' AS unit FROM supplier",
)
add(
    "weights_sd",
    lambda s, d: rounded(weights.Weights(band(s, d)).properties().select("sd", "mean_neighbors")),
    f"WITH {BANDED}, c AS (SELECT p.id, count(focal) AS k FROM p LEFT JOIN e0 ON focal = p.id GROUP BY p.id) SELECT round(stddev_pop(k), 6) AS sd, round(avg(k), 6) AS mean_neighbors FROM c",
)
