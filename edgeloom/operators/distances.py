"""Exact quantiles of all distances of a point set, without its pairs.

Points are counted by cells. The distances of two cells' points lie between the cells' least and greatest distance, so counts
of cell pairs bound the value at any rank from both sides. Cell pairs that lie wholly below or above these bounds are counted
and dropped; those that straddle them are split into cells of half the side, which narrows the bounds. When further splitting would
make more cell pairs than it spares point pairs, the points of the cell pairs that are left are compared. Work grows about
with n ** 1.5 in the plane, where all pairs are n ** 2.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..scratch import remove, write
from .joins import _on_sphere, minkowski


def order_values(df: DataFrame, column: str, ranks: set[int], parts: int = 4096, most: int = 20_000) -> dict[int, float]:
    """The values at ``ranks`` (from 0). The range is narrowed by counting values in equal parts of it, a partial aggregate each
    time, until ``most`` values at most are left to sort; so no task holds all values."""
    v = F.col(column)
    low, high, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    before = 0  # values under the range
    for _ in range(40):
        width = (high - low) / parts
        if n <= most or width <= 0 or low + width == low:
            break
        place = F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(parts - 1))
        counts = {r[0]: r[1] for r in df.filter(v.between(low, high)).groupBy(place).count().collect()}  # ``parts`` rows at most
        seen, hit = before, []
        for k in sorted(counts):
            if any(seen <= w < seen + counts[k] for w in ranks):
                hit.append(k)
            seen += counts[k]
        # ends a little wider than the parts, as their edges are rounded
        new = (max(low, low + (hit[0] - 1e-6) * width), min(high, low + (hit[-1] + 1 + 1e-6) * width))
        if new == (low, high):
            break
        low, high = new
        before, n = df.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
    if low == high:
        return dict.fromkeys(ranks, float(low))
    rows = df.filter(v.between(low, high))
    if n <= most:
        kept = sorted(r[0] for r in rows.select(v).collect())
        return {w: float(kept[w - before]) for w in ranks}
    out, seen = {}, before  # many equal values: count them by value
    for x, c in sorted((r[0], r[1]) for r in rows.groupBy(v).count().collect()):
        out |= {w: float(x) for w in ranks if seen <= w < seen + c}
        seen += c
    return out


def quantile(df: DataFrame, column: str, q: float, parts: int = 4096, most: int = 20_000) -> float | None:
    """Exact quantile with linear interpolation."""
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return None
    rank = q * (n - 1)
    return _between(order_values(df, column, {math.floor(rank), math.ceil(rank)}, parts, most), rank)


def _between(values: dict[int, float], rank: float) -> float:
    a, b = values[math.floor(rank)], values[math.ceil(rank)]
    return float(a + (b - a) * (rank - math.floor(rank)))


def distance_quantile(points: DataFrame, q: float, coords: tuple[str, ...] = ("x", "y"), p: float | None = 2, enough: int = 2_000_000) -> float | None:
    """The q-quantile, with linear interpolation, of the distances of all ordered pairs of different points; None for fewer than
    two. p None: great circles of lon and lat in km. ``enough``: point pairs that are compared without further splitting."""
    if p is None:
        ends = _ranked(_on_sphere(points), q, ("x", "y", "z"), 2, enough)
        chord = lambda d: points.sparkSession.range(1).select(sphere.linear_to_arc(F.lit(d))).first()[0]
        return None if ends is None else _between({k: chord(v) for k, v in ends[0].items()}, ends[1])
    ends = _ranked(points, q, coords, p, enough)
    return None if ends is None else _between(*ends)


def _ranked(points: DataFrame, q: float, coords: tuple[str, ...], p: float, enough: int) -> tuple[dict[int, float], float] | None:
    """The distances at the ranks on both sides of the quantile (of ordered pairs), and the quantile's rank."""
    spark = points.sparkSession
    at, at_path = write(points.select("id", *[F.col(c).cast("double").alias(c) for c in coords]))
    box = at.agg(F.count(F.lit(1)), *[f(c) for c in coords for f in (F.min, F.max)]).first()
    n = box[0]
    if n < 2:
        return None
    rank = q * (n * (n - 1) - 1)
    wanted = {math.floor(rank), math.ceil(rank)}
    pair_ranks = {w // 2 for w in wanted}  # each pair stands for both its orders
    low = {c: box[1 + 2 * k] for k, c in enumerate(coords)}
    span = max(max(box[2 + 2 * k] - low[c] for k, c in enumerate(coords)), 1e-300) * (1 + 1e-9)
    keys = [f"k_{c}" for c in coords]
    level, paths, below = max(1, 10 // len(coords)), [], 0
    side = lambda level: span / 2.0**level
    key = lambda level: [F.floor((F.col(c) - low[c]) / side(level)).cast("bigint").alias(f"k_{c}") for c in coords]
    named = lambda df, s: df.select(*[F.col(k).alias(f"{s}{k}") for k in keys], F.col("n").alias(f"{s}n"))

    def bounded(pairs: DataFrame, level: int) -> DataFrame:
        """Cell pairs with the least and greatest distance of their points, a trace wider for rounding, and their point pairs."""
        gaps = [F.abs(F.col(f"a{k}") - F.col(f"b{k}")) for k in keys]
        zero = tuple(F.lit(0.0) for _ in keys)
        near = minkowski(p, tuple(F.greatest(g - 1, F.lit(0)) * side(level) for g in gaps), zero) * (1 - 1e-9)
        far = minkowski(p, tuple((g + 1) * side(level) for g in gaps), zero) * (1 + 1e-9)
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"a{k}") == F.col(f"b{k}")
        weight = F.when(same, F.col("an") * (F.col("an") - 1) / 2).otherwise(F.col("an") * F.col("bn")).cast("bigint")
        return pairs.withColumns({"near": near, "far": far, "weight": weight}).filter("weight > 0")

    order = lambda s: F.struct(*[F.col(f"{s}{k}") for k in keys])
    cells, path = write(at.groupBy(*key(level)).agg(F.count(F.lit(1)).alias("n")))
    paths.append(path)
    pairs = named(cells, "a").join(named(cells, "b"), order("a") <= order("b"))  # 2 ** 10 cells at most on either side
    while True:
        pairs, path = write(bounded(pairs, level))
        paths.append(path)
        steps = pairs.groupBy("near", "far").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c")).collect()  # one row for each offset of cells
        lower, upper = _bounds([(r["near"], r["w"]) for r in steps], min(pair_ranks) - below), _bounds([(r["far"], r["w"]) for r in steps], max(pair_ranks) - below)
        below += sum(r["w"] for r in steps if r["far"] < lower)
        left = [r for r in steps if r["far"] >= lower and r["near"] <= upper]
        points_left, cells_left = sum(r["w"] for r in left), sum(r["c"] for r in left)
        pairs = pairs.filter((F.col("far") >= lower) & (F.col("near") <= upper))
        if points_left <= max(enough, 8 * cells_left) or level >= 45:
            break
        level += 1
        cells, path = write(at.groupBy(*key(level)).agg(F.count(F.lit(1)).alias("n")))
        paths.append(path)
        split = lambda s, cells=cells: named(cells, f"c{s}").select("*", *[F.shiftright(f"c{s}{k}", 1).alias(f"{s}{k}") for k in keys])
        pairs = pairs.select(*[f"{s}{k}" for s in "ab" for k in keys])
        for s in "ab":
            pairs = pairs.join(split(s), [f"{s}{k}" for k in keys])
        pairs = pairs.select(*[F.col(f"c{s}{k}").alias(f"{s}{k}") for s in "ab" for k in [*keys, "n"]])
        same = F.lit(True)  # children of one cell with itself: each pair once
        for k in keys:
            same &= F.shiftright(f"a{k}", 1) == F.shiftright(f"b{k}", 1)
        pairs = pairs.filter(~same | (order("a") <= order("b")))
    pairs = pairs.select(*[f"{s}{k}" for s in "ab" for k in keys])
    for s in "ab":
        held = at.select(*[k.alias(f"{s}k_{c}") for k, c in zip(key(level), coords, strict=True)], F.col("id").alias(f"{s}id"), *[F.col(c).alias(f"{s}{c}") for c in coords])
        pairs = pairs.join(held, [f"{s}{k}" for k in keys])
    twice = F.lit(True)
    for k in keys:
        twice &= F.col(f"a{k}") == F.col(f"b{k}")
    d = minkowski(p, *(tuple(F.col(f"{s}{c}") for c in coords) for s in "ab"))
    found = order_values(pairs.filter(~twice | (F.col("aid") < F.col("bid"))).select(d.alias("d")), "d", {r - below for r in pair_ranks})
    for path in [*paths, at_path]:
        remove(spark, path)
    return {w: found[w // 2 - below] for w in wanted}, rank


def _bounds(rows: list[tuple[float, int]], rank: int) -> float:
    """The least bound at which the counts reach the rank."""
    seen = 0
    for x, w in sorted(rows):
        seen += w
        if seen > rank:
            return x
    return rows and max(rows)[0] or 0.0
