"""Nine-intersection matrices of boxes, against rules for boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import relate
from ..operators import shapes
from .more import _LOTS, lot_parts
from .queries import add, supplier
from .scale import nation_boxes

_BIG = "big AS (SELECT s_nationkey::BIGINT AS nation, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t FROM q2 JOIN supplier ON s_suppkey = id GROUP BY 1)"


def matrices(spark, sf):
    met = shapes.candidates(nation_boxes(spark, sf), lot_parts(spark, sf))
    return met.select(F.col("l_id").alias("nation"), F.col("r_id").alias("lot"), relate.relate(F.col("l_parts"), F.col("r_parts")).alias("matrix"))


_STRICT = "({0}.l > {1}.l AND {0}.l < {1}.r AND iy > 0) OR ({0}.r > {1}.l AND {0}.r < {1}.r AND iy > 0) OR ({0}.b > {1}.b AND {0}.b < {1}.t AND ix > 0) OR ({0}.t > {1}.b AND {0}.t < {1}.t AND ix > 0)"
_HOLDS = "{0}.l >= {1}.l AND {0}.r <= {1}.r AND {0}.b >= {1}.b AND {0}.t <= {1}.t"
_WITHIN = "{0}.l > {1}.l AND {0}.r < {1}.r AND {0}.b > {1}.b AND {0}.t < {1}.t"

add(
    "polygon_relate",
    matrices,
    f"""WITH {_LOTS}, {_BIG},
m AS (
  SELECT a, c, least(a.r, c.r) - greatest(a.l, c.l) AS ix, least(a.t, c.t) - greatest(a.b, c.b) AS iy
  FROM big a JOIN q2 c ON a.l <= c.r AND c.l <= a.r AND a.b <= c.t AND c.b <= a.t
)
SELECT a.nation AS nation, c.id AS lot,
  CASE WHEN ix > 0 AND iy > 0 THEN '2' ELSE 'F' END || CASE WHEN {_STRICT.format("c", "a")} THEN '1' ELSE 'F' END || CASE WHEN {_HOLDS.format("a", "c")} THEN 'F' ELSE '2' END
  || CASE WHEN {_STRICT.format("a", "c")} THEN '1' ELSE 'F' END
  || CASE WHEN ((a.l = c.l OR a.r = c.r OR a.l = c.r OR a.r = c.l) AND iy > 0) OR ((a.b = c.b OR a.t = c.t OR a.b = c.t OR a.t = c.b) AND ix > 0) THEN '1'
       WHEN ({_WITHIN.format("a", "c")}) OR ({_WITHIN.format("c", "a")}) THEN 'F' ELSE '0' END
  || CASE WHEN {_HOLDS.format("a", "c")} THEN 'F' ELSE '1' END
  || CASE WHEN {_HOLDS.format("c", "a")} THEN 'F' ELSE '2' END || CASE WHEN {_HOLDS.format("c", "a")} THEN 'F' ELSE '1' END || '2' AS matrix
FROM m""",
)


def lots_of_points(spark, sf):
    """Matrices of the suppliers' places, brought into the lots' field, and the lots whose boxes they meet."""
    at = supplier(spark, sf).select("id", F.pmod(F.col("id") * 7, F.lit(10)).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    corner = F.array(F.array(F.struct("x", "y")))
    met = shapes.candidates(at.select("id", corner.alias("parts")), lot_parts(spark, sf))
    return met.select(F.col("l_id").alias("point"), F.col("r_id").alias("lot"), relate.relate_point(F.col("l_parts")[0][0], F.col("r_parts")).alias("matrix"))


add(
    "point_relate",
    lots_of_points,
    f"""WITH {_LOTS}, p AS (SELECT s_suppkey AS id, ((s_suppkey * 7) % 10)::DOUBLE AS x, (s_suppkey // 10)::DOUBLE AS y FROM supplier)
SELECT p.id AS point, q2.id AS lot, CASE WHEN x > l AND x < r AND y > b AND y < t THEN '0FFFFF212' ELSE 'F0FFFF212' END AS matrix
FROM p JOIN q2 ON x BETWEEN l AND r AND y BETWEEN b AND t""",
)
