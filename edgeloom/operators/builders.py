"""Builders of graphs from points, polygons, regimes, lattices, rasters, flows and networks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.kernels import kernel as kernel_value
from . import paths
from .boxes import box_join, boxed
from .distances import distance_quantile, quantile
from .flows import FlowGraph
from .graph import BlockGraph, Graph
from .joins import band_join, knn_join, minkowski, nearest_join, sphere_band_join, sphere_knn_join


def _graph(pairs: DataFrame, nodes: DataFrame, weight=None) -> Graph:
    w = F.lit(1.0) if weight is None else weight
    return Graph(pairs.select("focal", "neighbor", w.cast("double").alias("weight")), nodes.select("id"))


def block_contiguity(regimes: DataFrame) -> BlockGraph:
    """id, regime: a complete graph within each regime; a null regime has no neighbors."""
    return BlockGraph(regimes)


class BandGraph(Graph):
    """A binary distance band. Whether it has given links is asked of the points, so sets in common with a smaller graph are found without
    its own links."""

    tells = True

    def __init__(self, points: DataFrame, threshold: float, p: float, coords: tuple[str, ...], graph: Graph):
        self.points, self.threshold, self.p, self.coords = points, threshold, p, coords
        self.nodes, self.edges, self.transformation = graph.nodes, graph.edges, graph.transformation

    def among(self, links: DataFrame) -> DataFrame:
        ends = [self.points.select(F.col("id").alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in self.coords]) for end in ("focal", "neighbor")]
        d = minkowski(self.p, *[tuple(F.col(f"_{end}_{c}") for c in self.coords) for end in ("focal", "neighbor")])
        return links.join(ends[0], "focal").join(ends[1], "neighbor").filter((d <= self.threshold) & (F.col("focal") != F.col("neighbor"))).select(links.columns)


def distance_band(points: DataFrame, threshold: float, binary: bool = True, alpha: float = -1.0, kernel: str | None = None, bandwidth: float | None = None, p: float = 2, coords=("x", "y"), taper=True, decay=False) -> Graph:
    """Other points within the threshold, inclusive. Not binary: distance ** alpha (0 where that is infinite), or a kernel."""
    pairs = band_join(points, points, threshold, coords, p).filter("focal <> neighbor")
    d = F.col("distance")
    if kernel is not None:
        return _graph(pairs, points, kernel_value(d, bandwidth or threshold, kernel, taper, decay))
    if binary:
        return BandGraph(points, threshold, p, coords, _graph(pairs, points))
    return _graph(pairs, points, F.when(d == 0, 0.0).otherwise(F.pow(F.when(d != 0, d), F.lit(alpha))) if alpha < 0 else F.pow(d, F.lit(alpha)))


def sphere_band(points: DataFrame, arc: float, binary: bool = True) -> Graph:
    pairs = sphere_band_join(points, points, arc).filter("focal <> neighbor")
    return _graph(pairs, points, None if binary else F.try_divide(F.lit(1.0), F.col("distance")))


def representatives(points: DataFrame, coords=("x", "y")) -> DataFrame:
    """id, rep (least id at the same place) and the coordinates."""
    rep = points.groupBy(*coords).agg(F.min("id").alias("rep"))
    return points.select("id", *coords).join(rep, list(coords))


def induce_cliques(graph: Graph, reps: DataFrame, chunk: int = 512) -> Graph:
    """Copy each representative's edges to the points at its place, in both directions, and link those to each other.

    The members of a place are held in chunks of about ``chunk`` ids. Pairs of chunks are dealt out to tasks and only then expanded, so
    neither a place with many points nor a small table leaves the work to one task."""
    to = reps.select("id", "rep")
    size = to.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.ceil(F.col("n") / chunk))
    held = to.join(size, "rep").groupBy("rep", F.pmod(F.xxhash64("id"), F.col("m")).alias("part")).agg(F.collect_list("id").alias("ids"))
    a, b = (held.select(F.col("rep").alias(end), F.col("part").alias(f"{end}_part"), F.col("ids").alias(f"{end}_ids")) for end in ("focal", "neighbor"))
    own = size.select(F.col("rep").alias("focal"), F.col("rep").alias("neighbor"), F.lit(1.0).alias("weight"))
    both = graph.links().select("focal", "neighbor", "weight").filter("focal <> neighbor").unionByName(own)
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = both.join(a, "focal").join(b, "neighbor").repartition(tasks, "focal", "focal_part", "neighbor", "neighbor_part")
    pairs = blocks.select("neighbor_ids", "weight", F.explode("focal_ids").alias("focal")).select("focal", F.explode("neighbor_ids").alias("neighbor"), "weight")
    pairs = pairs.filter("focal <> neighbor").select("focal", "neighbor", F.col("weight").cast("double").alias("weight"))
    g = Graph(pairs, to.select("id"))
    lone = size.filter("n = 1").select(F.col("rep").alias("focal")).join(graph.links().select("focal"), "focal", "left_anti")
    g.edges = pairs.unionByName(lone.select("focal", F.col("focal").alias("neighbor"), F.lit(0.0).alias("weight")))  # isolates by places, not by a second look at all pairs
    return g


def expand_places(points: DataFrame, coords: tuple[str, ...], linked, chunk: int = 256) -> Graph:
    """The graph of points whose links and weights depend on their places alone. linked: gives focal, neighbor and weight for one point a
    place, with each place's link to itself, which its points have to each other.

    Places are linked first. Their neighbors are held in chunks of about ``chunk`` points, which are dealt out to tasks, so the
    links of points are only joined, and neither a place with many points nor a small table leaves the work to one task."""
    size = points.groupBy(*coords).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("m", F.ceil(F.col("n") / chunk))
    held = points.join(size, list(coords)).select("id", "rep", F.pmod(F.xxhash64("id"), F.col("m")).alias("part"))
    near = linked(size.select(F.col("rep").alias("id"), *coords))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = size.select(F.col("rep").alias("neighbor"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"))
    a = near.join(parts, "neighbor").join(held.select("id", F.col("rep").alias("focal")), "focal").select(F.col("neighbor").alias("rep"), "part", F.col("id").alias("focal"), "weight")
    b = held.select("rep", "part", F.col("id").alias("neighbor"))
    pairs = a.repartition(tasks, "rep", "part").join(b.repartition(tasks, "rep", "part").hint("merge"), ["rep", "part"])  # a merge goes chunk by chunk
    pairs = pairs.filter("focal <> neighbor").select("focal", "neighbor", F.col("weight").cast("double").alias("weight"))
    met = near.select(F.col("focal").alias("rep"), "neighbor").join(size.select("rep", "n"), "rep").filter("n > 1 OR rep <> neighbor").select("rep").distinct()
    lone = points.select(F.col("id").alias("focal")).join(held.join(met, "rep", "left_semi").select(F.col("id").alias("focal")), "focal", "left_anti")
    g = Graph(pairs, points.select("id"))
    g.edges = pairs.unionByName(lone.select("focal", F.col("focal").alias("neighbor"), F.lit(0.0).alias("weight")))  # isolates by places, not by a second look at all pairs
    return g


METRICS = {"euclidean": 2, "manhattan": 1, "cityblock": 1, "l1": 1, "l2": 2, "chebyshev": math.inf}


def _power(metric: str, p: float) -> float | None:
    """The Minkowski power of a metric's name; None for haversine."""
    if metric == "haversine":
        return None
    if metric == "minkowski":
        return p
    if metric not in METRICS:
        raise ValueError(f"metric must be minkowski, haversine or one of {', '.join(METRICS)}")
    return METRICS[metric]


def jitter(points: DataFrame, seed: int = 0, coords=("x", "y"), resolution: float = 1e-15) -> DataFrame:
    """Points that share a place are moved by a random length up to ``resolution`` times the size of their coordinates (and
    no less than a float can tell apart), in a random direction; others stay. The same seed and partitions give the same
    places."""
    shared = F.count(F.lit(1)).over(W.partitionBy(*coords)) > 1
    size = F.greatest(*[F.abs(F.col(c)) for c in coords], F.lit(1.0)) * (resolution * 1e3)
    r, turn = F.sqrt(F.rand(seed)) * size, F.rand(seed + 1) * (2 * math.pi)
    moved = points.withColumns({"_r": r, "_a": turn, "_s": shared})
    new = {c: F.when(F.col("_s"), F.col(c) + F.col("_r") * f(F.col("_a"))).otherwise(F.col(c)) for c, f in zip(coords, (F.sin, F.cos), strict=False)}
    return moved.withColumns(new).drop("_r", "_a", "_s")


def knn(points: DataFrame, k: int, p: float = 2, coords=("x", "y"), coplanar: str = "keep", kernel: str | None = None, metric: str = "minkowski", seed: int = 0) -> Graph:
    """k nearest other points, ties to the lesser id. metric: euclidean, manhattan, chebyshev, minkowski (with p), or
    haversine (columns lon and lat in degrees, distances in km). coplanar: keep (co-located points are neighbors at
    distance 0), raise, clique, or jitter (with a seed)."""
    p = _power(metric, p)
    coords = ("lon", "lat") if p is None else coords
    if coplanar == "jitter":
        from ..scratch import write

        points, _ = write(jitter(points, seed, coords))
    if coplanar in ("raise", "clique"):
        reps = representatives(points, coords)
        if coplanar == "raise":
            if not reps.filter("id <> rep").isEmpty():
                raise ValueError("points share a place; use coplanar='clique', 'jitter' or 'keep'")
        else:
            return induce_cliques(knn(reps.filter("id = rep").select("id", *coords), k, p or 2, coords, metric="haversine" if p is None else "minkowski"), reps)
    elif coplanar not in ("keep", "jitter"):
        raise ValueError("coplanar must be keep, raise, clique or jitter")
    pairs = sphere_knn_join(points, k) if p is None else knn_join(points, k, coords, p)
    return _graph(pairs, points, None if kernel is None else kernel_value(F.col("distance"), math.inf, kernel))


def all_pairs(points: DataFrame, p: float | None = 2, coords=("x", "y"), a_task: int = 20_000_000, block: int = 256) -> DataFrame:
    """focal, neighbor, distance of all pairs of different points, by its nature a row for each: for point sets of which the
    square can be afforded. p None: great circles of lon and lat in km. A small table is one split of one file, so the pairs are
    dealt out to tasks of about ``a_task`` each.

    Neighbors come in blocks of near points, each block with all focals in order of places. So the neighbors of a block return
    for each focal and like distances are side by side, which makes a file of all pairs far smaller than one by ids."""
    from ..scratch import write

    n = points.count()
    tasks = max(1, min(10_000, n, n * n // a_task))
    flat = points.select("id", *[F.col(c).cast("double").alias(c) for c in coords]).orderBy(*coords, "id")
    flat, _ = write(flat.withColumn("block", F.floor(F.monotonically_increasing_id() / block)))  # which counts the rows of each range of places
    a = flat.select(F.col("id").alias("focal"), *[F.col(c).alias(f"a_{c}") for c in coords]).crossJoin(F.broadcast(flat.select("block").distinct()))
    b = flat.select("block", F.col("id").alias("neighbor"), *[F.col(c).alias(f"b_{c}") for c in coords])
    ends = [tuple(F.col(f"{n}_{c}") for c in coords) for n in "ab"]
    d = sphere.harcdist(*ends[0], *ends[1]) if p is None else minkowski(p, *ends)
    pairs = a.repartition(tasks, "block").join(b.repartition(tasks, "block").hint("merge"), "block")  # a merge goes block by block
    return pairs.filter("focal <> neighbor").select("focal", "neighbor", d.alias("distance"))


def optimal_bandwidth(pairs: DataFrame, function: str, n: int, steps: int = 60) -> float:
    """The bandwidth up to twice the greatest distance whose kernel values are spread most evenly: the greatest entropy
    of their histogram over [0, 1] in int(sqrt(n)) bins. A golden-section search; each probe is one partial aggregate."""
    top = pairs.agg(F.max("distance")).first()[0]
    bins = max(1, int(n**0.5))

    def loss(h: float) -> float:
        value = kernel_value(F.col("distance"), h, function, False)
        place = F.when(value.between(0, 1), F.least(F.floor(value * bins), F.lit(bins - 1)))
        counts = [r[1] for r in pairs.groupBy(place.alias("b")).count().filter("b IS NOT NULL").collect()]  # ``bins`` rows
        total = sum(counts)
        return sum(c / total * math.log(c / total) for c in counts) if total else 0.0

    ratio = (math.sqrt(5) - 1) / 2
    low, high = 0.0, 2 * float(top or 0)
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(steps):
        if high - low <= 1e-5 * max(1.0, abs(high)):
            break
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return (low + high) / 2


def kernel(
    points: DataFrame, function="gaussian", k: int | None = None, bandwidth: float | str | None = None, p: float = 2, coords=("x", "y"), taper=True, decay=False,
    metric: str = "minkowski", zeros: bool = False,
) -> Graph:
    """Kernel weights over the k nearest, or within a bandwidth. Without k and bandwidth, the bandwidth is the lower
    quartile of all distances, found without making the pairs; with taper, only pairs within the bandwidth are links, unless
    ``zeros`` asks for the pairs beyond it too, with weight 0.
    ``auto`` spreads the weights most evenly; that, and kernels without taper, need every pair by their definition. metric: as in
    ``knn``."""
    p = _power(metric, p)
    coords = ("lon", "lat") if p is None else coords
    if k is None and bandwidth is None:
        bandwidth = distance_quantile(points, 0.25, coords, p) or 0.0
    if k is not None:
        pairs = sphere_knn_join(points, k) if p is None else knn_join(points, k, coords, p)
        h = F.lit(float(bandwidth)) if bandwidth is not None else F.col("_h")
        if bandwidth is None:
            pairs = pairs.crossJoin(F.broadcast(pairs.agg(F.max("distance").alias("_h"))))  # one row
    elif isinstance(bandwidth, (int, float)) and taper is True and not zeros:
        if p is None:
            weight = kernel_value(F.col("distance"), float(bandwidth), function, taper, decay).alias("weight")
            return expand_places(points.select("id", *coords), coords, lambda at: sphere_band_join(at, at, bandwidth).select("focal", "neighbor", weight))
        pairs = band_join(points, points, bandwidth, coords, p)
        pairs, h = pairs.filter("focal <> neighbor"), F.lit(float(bandwidth))
    else:
        pairs = all_pairs(points, p, coords)
        if bandwidth == "auto":
            bandwidth = optimal_bandwidth(pairs, function, points.count())
        h = F.lit(None if bandwidth is None else float(bandwidth)).cast("double")
        g = _graph(pairs, points, kernel_value(F.col("distance"), h, function, taper, decay))
        if points.count() > 1:  # no isolates, so the pairs needn't be made a second time to look for them
            g.edges = pairs.select("focal", "neighbor", kernel_value(F.col("distance"), h, function, taper, decay).alias("weight"))
        return g
    return _graph(pairs, points, kernel_value(F.col("distance"), h, function, taper, decay))


def kernel_from_distances(pairs: DataFrame, nodes: DataFrame, function="gaussian", bandwidth: float | None = None, taper=True, decay=False) -> Graph:
    """Kernel of precomputed distances (focal, neighbor, distance); without a bandwidth, their lower quartile."""
    h = quantile(pairs, "distance", 0.25) if bandwidth is None else bandwidth
    return _graph(pairs.filter("focal <> neighbor"), nodes, kernel_value(F.col("distance"), F.lit(h), function, taper, decay))


def nearest(points: DataFrame, others: DataFrame, k: int = 1, p: float = 2, coords=("x", "y"), metric: str = "minkowski") -> DataFrame:
    """focal (ids of ``points``), neighbor (ids of ``others``) and distance of the k nearest of another set."""
    from .joins import sphere_nearest_join

    p = _power(metric, p)
    return sphere_nearest_join(points, others, k) if p is None else nearest_join(points, others, k, coords, p)


def reweight(graph: Graph, points: DataFrame, k: int, new_points: DataFrame | None = None, p: float = 2, coords=("x", "y")) -> Graph:
    """The k nearest anew, with another k or p, or with further points; ``graph`` keeps its own edges."""
    both = points.select("id", *coords)
    if new_points is not None:
        both = both.unionByName(new_points.select("id", *coords))
    found = knn(both, k, p, coords)
    return found if graph.transformation == "O" else found.transform(graph.transformation)


def h3_rings(pairs: DataFrame, nodes: DataFrame, weight: str = "distance") -> Graph:
    """pairs: focal, neighbor, ring (grid distance, from an H3 library). weight: distance, binary or inverse."""
    ring = F.col("ring").cast("double")
    w = {"distance": ring, "binary": F.lit(1.0), "inverse": 1 / ring}.get(weight)
    if w is None:
        raise ValueError("weight must be distance, binary or inverse")
    inside = pairs.filter("ring > 0").join(nodes.select(F.col("id").alias("focal")), "focal", "left_semi").join(nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    return _graph(inside, nodes, w)


def adaptive_kernel(points: DataFrame, k: int = 2, function="triangular", eps: float = 1.0000001, coords=("x", "y")) -> Graph:
    """Each point's own bandwidth: the distance to its k-th neighbor times eps; the point itself included."""
    near = knn_join(points, k, coords)
    h = near.groupBy("focal").agg((F.max("distance") * eps).alias("_h"))
    own = points.select(F.col("id").alias("focal"), F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"))
    pairs = near.unionByName(own).join(h, "focal")
    return _graph(pairs, points, kernel_value(F.col("distance"), F.col("_h"), function))


def min_threshold_distance(points: DataFrame, p: float = 2, coords=("x", "y")) -> DataFrame:
    """Greatest distance to a nearest neighbor."""
    return knn_join(points, 1, coords, p).agg(F.max("distance").alias("threshold"))


# polygons: id, parts (array of rings, each array<struct<x,y>>)


def _sides(polygons: DataFrame) -> DataFrame:
    ring = polygons.select("id", F.explode("parts").alias("r"))
    ends = F.zip_with("r", F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return ring.select("id", F.explode(ends).alias("s")).filter("s.a <> s.b").select("id", "s.*").distinct()


def contiguity(polygons: DataFrame, rook: bool = True, by_perimeter: bool = False) -> Graph:
    """Rook: a common side; queen: a common vertex; exact coordinates. by_perimeter: length of the common sides."""
    if rook or by_perimeter:
        s, keys = _sides(polygons), ["a", "b"]
    else:
        s, keys = polygons.select("id", F.explode(F.flatten("parts")).alias("v")).distinct(), ["v"]
    pairs = s.withColumnRenamed("id", "focal").join(s.withColumnRenamed("id", "neighbor"), keys).filter("focal <> neighbor")
    if by_perimeter:
        length = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
        pairs = pairs.groupBy("focal", "neighbor").agg(F.sum(length).alias("weight"))
        return _graph(pairs, polygons, F.col("weight"))
    return _graph(pairs.select("focal", "neighbor").distinct(), polygons)


def box_contiguity(polygons: DataFrame, buffer: float = 0.0, tolerance: float | None = None) -> Graph:
    """Fuzzy contiguity of bounding boxes grown by ``buffer`` (or tolerance * 0.5 * the lesser extent of all boxes).

    Boxes are joined at the level of the larger one's size."""
    box = boxed(polygons.select("id", F.flatten("parts").alias("points")), F.col("points")).drop("points")
    size = box.agg((F.max("r") - F.min("l")).alias("w"), (F.max("t") - F.min("b")).alias("h")).first()
    grow = buffer if tolerance is None else tolerance * 0.5 * min(size["w"] or 0, size["h"] or 0)
    box = box.select("id", (F.col("l") - grow).alias("l"), (F.col("b") - grow).alias("b"), (F.col("r") + grow).alias("r"), (F.col("t") + grow).alias("t"))
    a, b = (box.select(*[F.col(c).alias(f"{n}_{c}") for c in box.columns]) for n in ("l", "r"))
    return _graph(box_join(a, b).filter("l_id <> r_id").select(F.col("l_id").alias("focal"), F.col("r_id").alias("neighbor")), polygons)


# regular structures: neighbors come from arithmetic, without a join

ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
BISHOP = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def lattice(spark: SparkSession, nrows: int, ncols: int, criterion: str = "rook") -> Graph:
    """ids row * ncols + column. criterion: rook, queen, bishop or hex (in odd columns also the lower, in even ones
    the upper diagonal cells)."""
    nodes = spark.range(nrows * ncols)
    r, c = F.floor(F.col("id") / ncols), F.col("id") % ncols
    cells = nodes.select("id", r.cast("bigint").alias("r"), c.alias("c"))
    steps = {"rook": ROOK, "queen": ROOK + BISHOP, "bishop": BISHOP, "hex": ROOK + BISHOP}[criterion]
    at = cells.select("id", "r", "c", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])).alias("s"))
    at = at.select("id", "c", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"), "s")
    at = at.filter(F.col("nr").between(0, nrows - 1) & F.col("nc").between(0, ncols - 1))
    if criterion == "hex":
        at = at.filter((F.col("s.dr") == 0) | (F.col("s.dc") == 0) | (F.col("s.dr") == F.when(F.col("c") % 2 == 1, 1).otherwise(-1)))
    return _graph(at.select(F.col("id").alias("focal"), (F.col("nr") * ncols + F.col("nc")).alias("neighbor")), nodes)


def raster_contiguity(cells: DataFrame, rook: bool = False, k: int = 1, nodata_cells: DataFrame | None = None) -> Graph:
    """cells: id, row, col of the cells with data. Queen or rook contiguity, up to order k. Steps to higher orders go through
    cells with data, and, where ``nodata_cells`` (row, col) are given, through those too."""
    if nodata_cells is not None and k > 1:
        lone = nodata_cells.select((-1 - F.xxhash64("row", "col").bitwiseAND(F.lit((1 << 62) - 1))).alias("id"), "row", "col")
        return raster_contiguity(cells.select(F.col("id").cast("bigint"), "row", "col").unionByName(lone), rook, k).subgraph(cells.select(F.col("id").cast("bigint")))
    steps = ROOK if rook else ROOK + BISHOP
    a = cells.select(F.col("id").alias("focal"), "row", "col", F.explode(F.array(*[F.struct(F.lit(x).alias("r"), F.lit(y).alias("c")) for x, y in steps])).alias("s"))
    a = a.select("focal", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    g = _graph(a.join(cells.select(F.col("id").alias("neighbor"), "row", "col"), ["row", "col"]), cells)
    return g if k == 1 else g.higher_order(k, lower_order=True)


def lattice_polygons(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """id and parts of unit squares, id row * ncols + column; ``sources.binary`` writes them as a shapefile."""
    cells = spark.range(nrows * ncols).select("id", F.floor(F.col("id") / ncols).cast("double").alias("y"), (F.col("id") % ncols).cast("double").alias("x"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return cells.select("id", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("parts"))


def test_raster(spark: SparkSession, layers: int = 3, rows: int = 4, cols: int = 4, nodata: float = -32768.0, missing: bool = True, seed: int = 12345) -> DataFrame:
    """layer, row, col and value of a made-up raster; with ``missing``, about a quarter of its cells hold ``nodata``."""
    at = spark.range(layers * rows * cols)
    value = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(255)) + 1).cast("double")
    gone = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(4)) == 0
    layer, rest = F.floor(F.col("id") / (rows * cols)), F.col("id") % (rows * cols)
    return at.select(layer.cast("int").alias("layer"), F.floor(rest / cols).cast("int").alias("row"), (rest % cols).cast("int").alias("col"), (F.when(gone, nodata).otherwise(value) if missing else value).alias("value"))


def check_raster(raster: DataFrame) -> None:
    """An error unless a raster has whole row and col, a numeric value, and one cell for each place."""
    kinds = dict(raster.dtypes)
    if any(kinds.get(c) not in ("tinyint", "smallint", "int", "bigint") for c in ("row", "col")):
        raise ValueError("a raster has the whole numbers row and col")
    if kinds.get("value") not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise ValueError("a raster has a numeric value")
    if not raster.groupBy(*[c for c in ("layer", "row", "col") if c in kinds]).count().filter("count > 1").isEmpty():
        raise ValueError("a raster has one value for each cell")


def raster_cells(raster: DataFrame, layer: int | None = None, nodata: float | None = None) -> DataFrame:
    """id (row by row from 0), row, col and value of the cells of a layer that hold data."""
    r = raster if layer is None else raster.filter(F.col("layer") == layer)
    box = r.agg((F.max("col") + 1).alias("_n"))  # one row
    r = r.filter(F.col("value").isNotNull() if nodata is None else F.col("value").isNotNull() & (F.col("value") != nodata))
    return r.crossJoin(F.broadcast(box)).select((F.col("row").cast("bigint") * F.col("_n") + F.col("col")).alias("id"), "row", "col", "value")


# flows and networks


def od_weights(origins: Graph, destinations: Graph, standardise: bool = True) -> Graph:
    """Kronecker product: flow (o, d) is next to flow (p, q) if o-p and d-q are links. ids: structs of o and d."""
    a, b = (g.transform("B").edges.filter("weight <> 0") for g in (origins, destinations))
    pair = lambda x, y: F.struct(x.alias("o"), y.alias("d"))
    e = a.select(F.col("focal").alias("of"), F.col("neighbor").alias("on")).crossJoin(b.select(F.col("focal").alias("df"), F.col("neighbor").alias("dn")))
    nodes = origins.nodes.select(F.col("id").alias("o")).crossJoin(destinations.nodes.select(F.col("id").alias("d"))).select(F.struct("o", "d").alias("id"))
    g = _graph(e.select(pair(F.col("of"), F.col("df")).alias("focal"), pair(F.col("on"), F.col("dn")).alias("neighbor")), nodes)
    return g.transform("R") if standardise else g


def net_weights(links: DataFrame, share: str = "A") -> FlowGraph:
    """links: id, o, d. Other links with the same origin (O), destination (D), either (OD), that begin where this one
    ends (C), or with any end in common (A). Lag, cardinalities and row standardisation make no edges."""
    return FlowGraph(links, share)


def vector_weights(flows: DataFrame, threshold: float, binary: bool = True, alpha: float = -1.0) -> Graph:
    """flows: id, ox, oy, dx, dy: a distance band in four dimensions."""
    return distance_band(flows, threshold, binary, alpha, coords=("ox", "oy", "dx", "dy"))


def attach_islands(graph: Graph, points: DataFrame, coords=("x", "y")) -> Graph:
    """Link each isolate to its nearest point, both ways, weight 1."""
    near = nearest_join(points.join(graph.isolates(), "id", "left_semi"), points, 1, coords, others=True).select("focal", "neighbor")
    both = near.unionByName(near.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"))).distinct()
    fresh = both.join(graph.links(), ["focal", "neighbor"], "left_anti").withColumn("weight", F.lit(1.0))
    return Graph(graph.links().unionByName(fresh), graph.nodes)


def travel_cost(points: DataFrame, edges: DataFrame, threshold: float, kernel: str | None = None, taper=True, decay=False) -> Graph:
    """points: id, node (of a network); edges: u, v, cost. Weight: cheapest cost up to the threshold, or its kernel;
    points at one node are linked at cost 0."""
    cost = paths.travel_costs(edges, points, threshold)
    a, b = points.select(F.col("id").alias("focal"), F.col("node").alias("origin")), points.select(F.col("id").alias("neighbor"), "node")
    pairs = cost.join(a, "origin").join(b, "node").filter("focal <> neighbor")
    w = F.col("cost") if kernel is None else kernel_value(F.col("cost"), threshold, kernel, taper, decay)
    return _graph(pairs, points, w)
