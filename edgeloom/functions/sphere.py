"""Great-circle functions as column expressions; longitudes and latitudes in degrees unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_EARTH_KM, RADIUS_EARTH_MILES = 6371.0, 3959.0


def haversine(x: Column) -> Column:
    return F.pow(F.sin(x / 2), F.lit(2))


def radangle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    h = haversine(F.radians(lat1 - lat0)) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * haversine(F.radians(lon1 - lon0))
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def harcdist(lon0, lat0, lon1, lat1, radius: float | None = RADIUS_EARTH_KM) -> Column:
    angle = radangle(lon0, lat0, lon1, lat1)
    return angle if radius is None else angle * radius


def to_xyz(lon: Column, lat: Column) -> Column:
    """Point of the unit sphere; longitude is shifted by pi and latitude by pi / 2."""
    phi, theta = F.radians(lon) + F.pi(), F.radians(lat) + F.pi() / 2
    return F.struct((F.sin(theta) * F.cos(phi)).alias("x"), (F.sin(theta) * F.sin(phi)).alias("y"), F.cos(theta).alias("z"))


def to_lnglat(xyz: Column) -> Column:
    """Inverse of to_xyz, in radians."""
    phi = F.atan2(xyz["y"], xyz["x"])
    return F.struct(F.when(phi > 0, phi - F.pi()).otherwise(phi + F.pi()).alias("lon"), (F.acos(xyz["z"]) - F.pi() / 2).alias("lat"))


def arcdist(lon0, lat0, lon1, lat1, radius: float = RADIUS_EARTH_KM) -> Column:
    """Distance by the chord between two points of the unit sphere."""
    a, b = to_xyz(lon0, lat0), to_xyz(lon1, lat1)
    chord = F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))
    return linear_to_arc(chord, radius)


def arc_to_linear(arc: Column, radius: float = RADIUS_EARTH_KM) -> Column:
    return F.sqrt(2 - 2 * F.cos(arc / radius))


def linear_to_arc(chord: Column, radius: float = RADIUS_EARTH_KM) -> Column:
    """Infinite chords stay infinite; chords over 2 are an error."""
    inf = F.lit(float("inf"))
    arc = radius * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - chord * chord / 2)))
    bad = F.raise_error(F.lit("a chord of the unit sphere is 2 at most")).cast("double")
    return F.when(chord == inf, inf).when(chord > 2 + 1e-9, bad).otherwise(arc)


def geointerpolate(lon0, lat0, lon1, lat1, t: Column) -> Column:
    """The point at fraction t of the great circle from the first point to the second."""
    d = radangle(lon0, lat0, lon1, lat1)
    k, j = F.sin((1 - t) * d) / F.sin(d), F.sin(t * d) / F.sin(d)
    p, q = [F.radians(v) for v in (lon0, lat0)], [F.radians(v) for v in (lon1, lat1)]
    x = k * F.cos(p[1]) * F.cos(p[0]) + j * F.cos(q[1]) * F.cos(q[0])
    y = k * F.cos(p[1]) * F.sin(p[0]) + j * F.cos(q[1]) * F.sin(q[0])
    z = k * F.sin(p[1]) + j * F.sin(q[1])
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))


def geogrid(spark, upper: tuple[float, float], lower: tuple[float, float], k: int):
    """(k + 1)^2 points between two corners, rows along parallels: i, j, lon, lat."""
    g = spark.range((k + 1) ** 2).select((F.col("id") / (k + 1)).cast("int").alias("i"), (F.col("id") % (k + 1)).cast("int").alias("j"))
    left = geointerpolate(F.lit(upper[0]), F.lit(upper[1]), F.lit(upper[0]), F.lit(lower[1]), F.col("i") / k)
    right = geointerpolate(F.lit(lower[0]), F.lit(upper[1]), F.lit(lower[0]), F.lit(lower[1]), F.col("i") / k)
    g = g.withColumns({"l": left, "r": right})
    return g.select("i", "j", geointerpolate(F.col("l.lon"), F.col("l.lat"), F.col("r.lon"), F.col("r.lat"), F.col("j") / k).alias("p")).select("i", "j", "p.*")
