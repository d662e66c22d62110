"""Queries of triangulations, Voronoi graphs and alpha shapes, over two numbers of each embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes, triangulation
from .more import _DELAUNAY, _PTS
from .queries import EMB, add, edges, rounded

ALPHA = 20.0

# A side of the Voronoi diagram lies on the bisector of two sites, at mid + t * normal: every other site and every side of the
# box leaves a half line of it.
_SIDES = f"""{_PTS},
box AS (SELECT min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t FROM p),
ab AS (
  SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny
  FROM p a JOIN p b ON a.id < b.id
),
half AS (
  SELECT i, j, 2 * (nx * (c.x - ax) + ny * (c.y - ay)) AS f, c.x ** 2 + c.y ** 2 - ax ** 2 - ay ** 2 - 2 * (mx * (c.x - ax) + my * (c.y - ay)) AS g
  FROM ab JOIN p c ON c.id <> i AND c.id <> j
  UNION ALL SELECT i, j, nx, r - mx FROM ab, box
  UNION ALL SELECT i, j, -nx, mx - l FROM ab, box
  UNION ALL SELECT i, j, ny, t - my FROM ab, box
  UNION ALL SELECT i, j, -ny, my - b FROM ab, box
),
part AS (
  SELECT i, j, min(g / f) FILTER (f > 0) - max(g / f) FILTER (f < 0) AS size, bool_and(g >= 0) FILTER (f = 0) AS good
  FROM half GROUP BY i, j
),
side AS (SELECT i, j, size * sqrt(nx * nx + ny * ny) AS length FROM part JOIN ab USING (i, j) WHERE coalesce(good, true) AND size > 0)"""

add(
    "voronoi_rook",
    lambda s, d: edges(triangulation.triangulation(EMB(s, d), "voronoi")),
    f"""WITH {_SIDES}, one AS (SELECT i, j FROM side, box WHERE length > 1e-9 * greatest(r - l, t - b))
SELECT i AS focal, j AS neighbor, 1::DOUBLE AS weight FROM one UNION ALL SELECT j, i, 1 FROM one""",
)


def voronoi_sides(spark, sf):
    sides, _ = triangulation.dual(EMB(spark, sf), 0.0)
    return rounded(sides.filter("NOT point AND length > 1e-9").select("p", "q", "length"))


add("voronoi_sides", voronoi_sides, f"WITH {_SIDES} SELECT i AS p, j AS q, round(length, 6) AS length FROM side WHERE length > 1e-9")

# Triangles: on each side of a Delaunay edge, the corner whose circle through the edge is the first that the others leave empty.
_TRIANGLES = f"""{_DELAUNAY},
corner AS (
  SELECT focal, neighbor, arg_min(c, g / s) FILTER (s > 0) AS c1, arg_max(c, g / s) FILTER (s < 0) AS c2
  FROM (SELECT focal, neighbor, c.id AS c, (c.x - mx) * nx + (c.y - my) * ny AS s, (c.x - mx) ** 2 + (c.y - my) ** 2 - h AS g
        FROM ab JOIN one USING (focal, neighbor) JOIN p c ON c.id <> focal AND c.id <> neighbor)
  GROUP BY focal, neighbor
),
tri AS (
  SELECT DISTINCT k[1] AS a, k[2] AS b, k[3] AS c
  FROM (SELECT list_sort([focal, neighbor, c1]) AS k FROM corner WHERE c1 IS NOT NULL UNION ALL SELECT list_sort([focal, neighbor, c2]) FROM corner WHERE c2 IS NOT NULL)
),
sized AS (
  SELECT t.*, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) AS lc, sqrt((pa.x - pc.x) ** 2 + (pa.y - pc.y) ** 2) AS lb,
    sqrt((pb.x - pc.x) ** 2 + (pb.y - pc.y) ** 2) AS la, abs((pb.x - pa.x) * (pc.y - pa.y) - (pc.x - pa.x) * (pb.y - pa.y)) / 2 AS area
  FROM tri t JOIN p pa ON pa.id = a JOIN p pb ON pb.id = b JOIN p pc ON pc.id = c
),
kept AS (SELECT * FROM sized WHERE la * lb * lc / (4 * area) < 1 / {ALPHA}),
rim AS (
  SELECT u, v, any_value(length) AS length
  FROM (SELECT a AS u, b AS v, lc AS length FROM kept UNION ALL SELECT a, c, lb FROM kept UNION ALL SELECT b, c, la FROM kept)
  GROUP BY u, v HAVING count(*) = 1
)"""


def alpha_shape(spark, sf):
    parts = triangulation.alpha_polygons(EMB(spark, sf), ALPHA)
    return rounded(parts.agg(F.sum("area").alias("area"), F.sum(shapes.polygon_length(F.col("parts"))).alias("length")))


add("alpha_shape_area", alpha_shape, f"WITH {_TRIANGLES} SELECT round((SELECT sum(area) FROM kept), 6) AS area, round((SELECT sum(length) FROM rim), 6) AS length")


def circles(spark, sf):
    at = EMB(spark, sf)
    found = triangulation.bounding_circles(at, ALPHA).withColumnsRenamed({"x": "ox", "y": "oy"}).join(at.withColumnRenamed("id", "a"), "a")
    r = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return rounded(found.agg(F.count(F.lit(1)).alias("circles"), F.min(r).alias("least"), F.max(r).alias("greatest")))


add("bounding_circles", circles, f"WITH {_TRIANGLES} SELECT count(*) AS circles, round({1 / ALPHA}::DOUBLE, 6) AS least, round({1 / ALPHA}::DOUBLE, 6) AS greatest FROM rim")
