"""The older weights surface over the same edges: transforms restart from the original weights, cardinalities count
list entries, and set operations choose their ids by ``shape``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph, numbered


class Weights:
    def __init__(self, graph: Graph):
        self.original = Graph(graph.edges, graph.nodes)
        self.graph, self.code = self.original, "O"

    @classmethod
    def from_adjlist(cls, df: DataFrame, focal_col="focal", neighbor_col="neighbor", weight_col: str | None = None) -> Weights:
        """Self-loops are left out; without a weight column, weights are 1."""
        w = F.col(weight_col) if weight_col else F.lit(1.0)
        e = df.select(F.col(focal_col).alias("focal"), F.col(neighbor_col).alias("neighbor"), w.alias("weight"))
        ends = e.select(F.col("focal").alias("id")).unionByName(e.select(F.col("neighbor").alias("id"))).distinct()
        return cls(Graph(e.filter("focal <> neighbor"), ends))

    def to_adjlist(self, remove_symmetric: bool = False, drop_islands: bool = True) -> DataFrame:
        e = self.graph.links() if drop_islands else self.graph.edges
        return filter_adjlist(e) if remove_symmetric else e

    @property
    def transform(self) -> str:
        return self.code

    @transform.setter
    def transform(self, code: str) -> None:
        code = code.upper()
        self.graph = self.original if code == "O" else self.original.transform(code)
        self.code = code

    def cardinalities(self) -> DataFrame:
        return self.graph.edges.groupBy(F.col("focal").alias("id")).agg(F.count_if(~((F.col("focal") == F.col("neighbor")) & (F.col("weight") == 0))).alias("cardinality"))

    def properties(self) -> DataFrame:
        """One row: n, nonzero, pct_nonzero, max/min/mean/sd of cardinalities (population sd), n_islands."""
        c = self.cardinalities().agg(F.count(F.lit(1)).alias("n"), F.sum("cardinality").alias("nonzero"), F.max("cardinality").alias("max_neighbors"), F.min("cardinality").alias("min_neighbors"), F.avg("cardinality").alias("mean_neighbors"), F.stddev_pop("cardinality").alias("sd"), F.count_if(F.col("cardinality") == 0).alias("n_islands"))
        return c.withColumn("pct_nonzero", 100.0 * F.col("nonzero") / (F.col("n") * F.col("n")))

    def __iter__(self):
        """(id, {neighbor: weight}) of each id in order, streamed to the driver."""
        for r in self.graph.neighbors().orderBy("id").toLocalIterator():
            yield r["id"], dict(zip(r["neighbors"], r["weights"], strict=True))

    def __getitem__(self, item) -> dict:
        return {r["neighbor"]: r["weight"] for r in self.graph[item].collect()}

    def places(self) -> DataFrame:
        """id and ord, its place from 0: in the order of ids."""
        return numbered(self.graph.nodes)

    @classmethod
    def from_networkx(cls, spark, graph, weight: str | None = "weight") -> Weights:
        return cls(Graph.from_networkx(spark, graph, weight))

    def to_networkx(self):
        return self.graph.to_networkx()

    def set_shapefile(self, name: str, id_variable: str | None = None, full: bool = False) -> Weights:
        """Remember the file and id column that the weights came from (written into file headers by users)."""
        self.source = {"name": name if full else name.rpartition("/")[2].rpartition(".")[0] or name, "id_variable": id_variable}
        return self

    def plot(self, points: DataFrame, **options) -> str:
        return self.graph.plot(points, **options)

    def islands(self) -> DataFrame:
        return self.cardinalities().filter("cardinality = 0").select("id")

    def symmetrize(self) -> Weights:
        """Missing reverse links get the forward weight; unequal pairs stay."""
        e = self.graph.links()
        back = e.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), "weight").join(e, ["focal", "neighbor"], "left_anti")
        return Weights(Graph(e.unionByName(back), self.graph.nodes))

    def neighbor_offsets(self) -> DataFrame:
        """id and the places of its neighbors in the order of ids."""
        return self.graph.to_sparse().groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("offsets"))

    def lag_categorical(self, y: DataFrame, value: str | tuple[str, ...] = "y", ties: str = "tryself", seed: int = 0) -> DataFrame:
        """Label with the greatest sum of weights. ties: lowest, highest, random (by a hash with ``seed``), or tryself (the
        own label, counted with the mean weight of its links, decides; then the lowest). Of several columns: lag_<name> each."""
        if not isinstance(value, str):
            out = self.graph.nodes
            for c in value:
                out = out.join(self.lag_categorical(y, c, ties, seed).withColumnRenamed("lag", f"lag_{c}"), "id", "left")
            return out
        if ties not in ("lowest", "highest", "random", "tryself"):
            raise ValueError("ties must be lowest, highest, random or tryself")
        own = y.select(F.col("id").alias("focal"), F.col(value).alias("own"))
        e = self.graph.links().join(y.select(F.col("id").alias("neighbor"), F.col(value).alias("y")), "neighbor")
        tally = e.groupBy("focal", "y").agg(F.sum("weight").alias("t"))
        top = F.max("t").over(W.partitionBy("focal"))
        best = tally.withColumn("m", top).filter("t = m").join(own, "focal", "left")
        first = {"tryself": F.coalesce(F.col("y") != F.col("own"), F.lit(True)).cast("bigint"), "random": F.xxhash64(F.lit(seed), "focal", "y")}.get(ties, F.lit(0).cast("bigint"))
        pick = F.max(F.struct(first.alias("f"), "y")) if ties == "highest" else F.min(F.struct(first.alias("f"), "y"))
        return best.groupBy(F.col("focal").alias("id")).agg(pick.alias("p")).select("id", F.col("p.y").alias("lag"))


class SparseWeights:
    """Weights as cells (i, j, w) by place, with the ids of the places (ord, id)."""

    def __init__(self, cells: DataFrame, ids: DataFrame):
        bad = cells.select(F.explode(F.array("i", "j")).alias("ord")).distinct().join(ids, "ord", "left_anti")
        if not bad.isEmpty():
            raise ValueError("a cell's place has no id")
        self.cells, self.ids = cells.select("i", "j", F.col("w").cast("double").alias("w")), ids.select("ord", "id")

    @classmethod
    def from_weights(cls, w: Weights) -> SparseWeights:
        return cls(w.graph.to_sparse(), w.places())

    def to_weights(self) -> Weights:
        return Weights(Graph.from_sparse(self.cells, self.ids))

    def diag_gtg_gg(self) -> DataFrame:
        return Graph.from_sparse(self.cells, self.ids).diag_gtg_gg()


def encode_labels(df: DataFrame, column: str) -> DataFrame:
    """``df`` with code: the place, from 0, of the column's value among its sorted distinct values."""
    codes = numbered(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct())
    return df.join(codes.select(F.col("id").alias(column), F.col("ord").alias("code")), column, "left")


def combinations(items: DataFrame, n: int = 2) -> DataFrame:
    """All sets of n different ids, as columns c1 < c2 < ...: by its nature a row for each set."""
    out = items.select(F.col("id").alias("c1"))
    for k in range(2, n + 1):
        out = out.join(items.select(F.col("id").alias(f"c{k}")), F.col(f"c{k - 1}") < F.col(f"c{k}"))
    return out


def filter_adjlist(e: DataFrame, focal: str = "focal", neighbor: str = "neighbor") -> DataFrame:
    """One of (a, b) and (b, a): the one with the lesser focal id."""
    pair = W.partitionBy(F.least(focal, neighbor), F.greatest(focal, neighbor)).orderBy(focal)
    return e.withColumn("_r", F.row_number().over(pair)).filter("_r = 1").drop("_r")


def adjlist_apply(e: DataFrame, attributes: DataFrame, func, *columns: str) -> DataFrame:
    """e with func(value at focal, value at neighbor) of each attribute column, as ``<column>_<n>``."""
    out = e
    for end in ("focal", "neighbor"):
        out = out.join(attributes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return out.select("*", *[func(F.col(f"{c}_focal"), F.col(f"{c}_neighbor")).alias(f"{c}_apply") for c in columns])


def adjlist_map(e: DataFrame, attributes: DataFrame, functions: dict) -> DataFrame:
    """e with, for each name and (function, columns) of ``functions``, the function of the columns' values at focal and at neighbor."""
    need = sorted({c for _, columns in functions.values() for c in columns})
    out = e
    for end in ("focal", "neighbor"):
        out = out.join(attributes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in need]), end)
    values = {name: f(*[F.col(f"{c}_{end}") for c in columns for end in ("focal", "neighbor")]) for name, (f, columns) in functions.items()}
    return out.withColumns(values).drop(*[f"{c}_{end}" for c in need for end in ("focal", "neighbor")])


def _nodes(a: Graph, b: Graph, shape: str, kept: DataFrame) -> DataFrame:
    if shape == "w1":
        return a.nodes
    if shape == "all":
        return a.nodes.unionByName(b.nodes).distinct()
    if shape == "min":
        return kept.select(F.explode(F.array("focal", "neighbor")).alias("id")).distinct()
    raise ValueError("shape must be w1, all or min")


def _pairs(a: Graph, b: Graph, how: str) -> DataFrame:
    return a.links().select("focal", "neighbor").join(b.links().select("focal", "neighbor"), ["focal", "neighbor"], how)


def union(a: Graph, b: Graph) -> Graph:
    e = a.links().select("focal", "neighbor").unionByName(b.links().select("focal", "neighbor")).distinct()
    return Graph(e.withColumn("weight", F.lit(1.0)), a.nodes.unionByName(b.nodes).distinct())


def intersection(a: Graph, b: Graph, shape: str = "w1") -> Graph:
    e = _pairs(a, b, "left_semi")
    return Graph(e.withColumn("weight", F.lit(1.0)), _nodes(a, b, shape, e))


def difference(a: Graph, b: Graph, shape: str = "w1", constrained: bool = True) -> Graph:
    """constrained: only ids that b lacks keep their place, if shape is all or min."""
    e = _pairs(a, b, "left_anti")
    nodes = _nodes(a, b, shape, e)
    if constrained and shape != "w1":
        nodes = nodes.join(a.nodes, "id", "left_semi")
    return Graph(e.withColumn("weight", F.lit(1.0)), nodes)


def symmetric_difference(a: Graph, b: Graph, shape: str = "all") -> Graph:
    e = _pairs(a, b, "left_anti").unionByName(_pairs(b, a, "left_anti"))
    return Graph(e.withColumn("weight", F.lit(1.0)), _nodes(a, b, shape, e))


def neighbor_equality(a: Graph, b: Graph) -> bool:
    return all(x.exceptAll(y).isEmpty() for f in (lambda g: g.nodes, lambda g: g.links().select("focal", "neighbor")) for x, y in ((f(a), f(b)), (f(b), f(a))))
