"""Matching of points with the least total distance: of two sets (each left point gets k different right points, and a right
point serves once), or within one set (each point gets k others, both ways).

Of two sets, each left point begins with its nearest right points only. Left points that share right points, directly or over
others, make a component; components are solved apart from each other, each exactly, by shortest augmenting paths over the lists. The
dual prices of a solution are its certificate: a left point whose price isn't above the distance of its last listed point
couldn't gain from any point beyond the list. The lists of the others are made longer, and the components that change are solved
anew, until all hold. So the total is that of the best matching over all pairs, and no pairs beyond the lists are made.

Within one set the best matching is one problem over all points; its solver is for one task, and ``max_points`` bounds it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, write
from .graph import Graph
from .joins import nearest_join


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row, rows <= columns, least total cost (potentials and augmenting paths)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            gap = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < low[1:])
            low[1:][better], way[1:][better] = gap[better], j0
            free = np.where(used[1:], np.inf, low[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return out


def half_matching(cost: np.ndarray, banned: frozenset = frozenset(), forced: frozenset = frozenset()) -> np.ndarray | None:
    """The least-cost matching within one set in which pairs may count half: the symmetric part of the best assignment of
    the set to itself, which is the optimum of the relaxed problem. Pairs in ``forced`` count whole; None if impossible."""
    c = cost.copy()
    big = 1e9 * (1 + np.abs(cost[np.isfinite(cost)]).max(initial=0))
    np.fill_diagonal(c, big)
    for i, j in banned:
        c[i, j] = c[j, i] = big
    for i, j in forced:
        kept = c[i, j], c[j, i]
        c[[i, j], :] = big
        c[:, [i, j]] = big
        c[i, j], c[j, i] = kept
    to = assign(c)
    if (c[np.arange(len(c)), to] >= big).any():
        return None
    x = np.zeros_like(c)
    x[np.arange(len(c)), to] = 0.5
    return x + x.T


def whole_matching(cost: np.ndarray) -> np.ndarray:
    """The least-cost matching of an even number of points in pairs: half matchings, with a half pair forced or banned in
    turn (branch and bound), until the best has none."""
    best, top, stack = None, np.inf, [(frozenset(), frozenset())]
    while stack:
        banned, forced = stack.pop()
        x = half_matching(cost, banned, forced)
        if x is None:
            continue
        total = float((np.triu(x, 1) * cost).sum())
        if total >= top - 1e-12:
            continue
        half = np.argwhere(np.triu(x == 0.5, 1))
        if not len(half):
            best, top = x, total
            continue
        pair = tuple(half[0].tolist())
        stack += [(banned | {pair}, forced), (banned, forced | {pair})]
    if best is None:
        raise ValueError("the points can't be matched in pairs")
    return best


def matches_within(points: DataFrame, partial: bool = False, max_points: int = 500) -> Graph:
    """points: id, x, y. Each point is matched with another one, with the least total distance. An odd number of points needs
    ``partial``, by which pairs may count half (weight 0.5), as in the relaxed problem."""
    n = points.count()
    if n > max_points:
        raise ValueError(f"matching is a single task; {max_points} points at most")
    if n % 2 and not partial:
        raise ValueError("an odd number of points has no matching in pairs; use partial=True")
    kind = dict(points.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        cost = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        x = half_matching(cost) if partial else whole_matching(cost)
        i, j = np.nonzero(x)
        return pd.DataFrame({"focal": ids[i], "neighbor": ids[j], "weight": x[i, j]})

    pairs = points.select("id", "x", "y", F.lit(0).alias("side")).groupBy("side").applyInPandas(run, f"focal {kind}, neighbor {kind}, weight double")
    return Graph(pairs, points.select("id"))


def assign_listed(lists: list[list[tuple[int, float]]], rights: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """Least-cost matching of lefts to different rights on their lists (right, cost): the right of each left (-1: none), the price
    of each left, and the lefts that the lists leave without one, with all those they compete with."""
    price_left, price_right = np.array([min((c for _, c in x), default=0.0) for x in lists]), np.zeros(rights)
    owner, of = np.full(rights, -1), np.full(len(lists), -1)
    short: set[int] = set()
    for start in range(len(lists)):
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        tree, heap = [(start, 0.0)], [(c - price_left[start] - price_right[j], j, start) for j, c in lists[start]]
        heapq.heapify(heap)
        end = None
        while heap:
            d, j, i = heapq.heappop(heap)
            if j in done:
                continue
            done[j], came[j] = d, i
            if owner[j] < 0:
                end = j
                break
            i = int(owner[j])
            tree.append((i, d))
            for k, c in lists[i]:
                if k not in done:
                    new = d + c - price_left[i] - price_right[k]
                    if new < best.get(k, np.inf):
                        best[k] = new
                        heapq.heappush(heap, (new, k, i))
        if end is None:
            short |= {i for i, _ in tree}
            continue
        reach = done[end]
        for i, d in tree:
            price_left[i] += reach - d
        for j, d in done.items():
            price_right[j] -= reach - d
        while True:  # along the path, each left takes the right that it came by
            i = came[end]
            owner[end], of[i], end = i, end, int(of[i])
            if i == start:
                break
    return of, price_left, short


def spatial_matches(left: DataFrame, right: DataFrame, k: int = 1, most_links: int = 5_000_000) -> Graph:
    """left, right: id, x, y, with ids of one kind. Points at equal distances may be matched either way; the total is the least.
    Left points that compete for the same right points over all of the area are one component, and a component is one task's:
    ``most_links`` bounds its lists."""
    n, m = left.count(), right.count()
    if n * k > m:
        raise ValueError("there are fewer right points than matches")
    kind = dict(left.dtypes)["id"]
    nodes = left.select("id").unionByName(right.select("id")).distinct()
    spark = left.sparkSession
    if not n:
        return Graph(spark.createDataFrame([], f"focal {kind}, neighbor {kind}, weight double"), nodes)
    flat = lambda df: df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    left, right = flat(left), flat(right)
    size = min(m, 2 * k + 2)
    lists, path = write(nearest_join(left, right, size).withColumn("size", F.lit(size)))

    def solve(group: pa.Table) -> pa.Table:
        rows = group.select(["focal", "neighbor", "distance", "size"]).to_pandas().sort_values(["focal", "distance", "neighbor"])
        lefts, i = np.unique(rows["focal"], return_inverse=True)
        rights, j = np.unique(rows["neighbor"], return_inverse=True)
        d, sizes = rows["distance"].to_numpy(), rows.groupby("focal")["size"].max().to_numpy()
        ends = np.searchsorted(i, np.arange(len(lefts) + 1))
        each = [list(zip(j[a:b].tolist(), d[a:b].tolist(), strict=True)) for a, b in zip(ends, ends[1:], strict=False)]
        of, price, short = assign_listed([x for x in each for _ in range(k)], len(rights))
        last = np.where(sizes >= m, np.inf, d[ends[1:] - 1])
        wide = {x // k for x in short} | set((np.flatnonzero(price > np.repeat(last, k) * (1 + 1e-12)) // k).tolist())
        keep = [x for x in range(len(of)) if of[x] >= 0]
        focal = [lefts[x // k] for x in keep] + [lefts[x] for x in sorted(wide)]
        neighbor = [rights[of[x]] for x in keep] + [None] * len(wide)
        schema = group.schema
        return pa.table([pa.array(focal, schema.field("focal").type), pa.array(neighbor, schema.field("neighbor").type)], ["focal", "neighbor"])

    while True:
        named = lists.select(F.concat(F.lit("l"), F.col("focal").cast("string")).alias("focal"), F.concat(F.lit("r"), F.col("neighbor").cast("string")).alias("neighbor"), F.lit(1.0).alias("weight"))
        both = named.unionByName(named.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), "weight"))
        labels = Graph(both, both.select(F.col("focal").alias("id")).distinct()).component_labels()
        held = lists.withColumn("id", F.concat(F.lit("l"), F.col("focal").cast("string"))).join(labels, "id")
        largest = held.groupBy("component").count().agg(F.max("count")).first()[0]
        if largest > most_links:
            raise ValueError(f"{largest} links of points that compete with each other; {most_links} at most")
        found, found_path = write(held.groupBy("component").applyInArrow(solve, f"focal {kind}, neighbor {kind}"))
        wide = found.filter("neighbor IS NULL").select(F.col("focal").alias("id"))
        if wide.isEmpty():
            remove(spark, path)
            return Graph(found.withColumn("weight", F.lit(1.0)), nodes)
        size = min(m, 4 * size)
        more = nearest_join(left.join(wide, "id"), right, size).withColumn("size", F.lit(size))
        kept = lists.join(wide.withColumnRenamed("id", "focal"), "focal", "left_anti")
        new, new_path = write(kept.select("focal", "neighbor", "distance", "size").unionByName(more.select("focal", "neighbor", "distance", "size")))
        for old in (path, found_path):
            remove(spark, old)
        lists, path = new, new_path
