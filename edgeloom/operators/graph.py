"""The graph: an edge relation (focal, neighbor, weight) with a node list, and what is computed on it.

A node without neighbors has the edge (id, id, 0). All results are lazy DataFrames keyed by id, but for the few
documented scalars. Order of ids is by value, since rows of a DataFrame have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import paths

TRANSFORMATIONS = "OBRDVC"
STATISTICS = ("count", "mean", "median", "std", "min", "max", "sum", "nunique", "mode")


def with_isolates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add (id, id, 0) for nodes without an edge of their own."""
    lone = nodes.select(F.col("id").alias("focal")).join(edges.select("focal").distinct(), "focal", "left_anti")
    return edges.select("focal", "neighbor", "weight").unionByName(lone.select("focal", F.col("focal").alias("neighbor"), F.lit(0.0).alias("weight")))


def numbered(nodes: DataFrame) -> DataFrame:
    """id and ord, its place from 0 in the order of ids: sorted by ranges, and numbered from each range's first place, so
    that no task sees all rows."""
    from ..scratch import write

    rows, _ = write(nodes.select("id").orderBy("id").withColumn("part", F.spark_partition_id()))
    size = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = size.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    own = F.row_number().over(W.partitionBy("part").orderBy("id"))
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("own") - 1).cast("bigint").alias("ord"))


class Graph:
    tells = False  # whether ``among`` does without the graph's own links

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, transformation: str = "O"):
        missing = {"focal", "neighbor", "weight"} - set(edges.columns)
        if missing:
            raise ValueError(f"edges lack the columns {sorted(missing)}")
        if dict(edges.dtypes)["weight"] in ("string", "boolean", "date", "timestamp"):
            raise ValueError("weight must be numeric")
        if transformation.upper() not in TRANSFORMATIONS:
            raise ValueError(f"transformation must be one of {', '.join(TRANSFORMATIONS)}")
        e = edges.select("focal", "neighbor", F.col("weight").cast("double").alias("weight"))
        ends = e.select(F.col("focal").alias("id")).unionByName(e.select(F.col("neighbor").alias("id"))).distinct()
        self.nodes = nodes.select("id") if nodes is not None else ends
        self.edges = with_isolates(e, self.nodes)
        self.transformation = transformation.upper()

    def validate(self) -> Graph:
        """One pass: no null in any column and no repeated pair."""
        bad = self.edges.filter("focal IS NULL OR neighbor IS NULL OR weight IS NULL")
        if not bad.isEmpty():
            raise ValueError("edges have missing values")
        if not self.edges.groupBy("focal", "neighbor").count().filter("count > 1").isEmpty():
            raise ValueError("edges have repeated pairs")
        return self

    # constructors

    @classmethod
    def from_adjacency(cls, df: DataFrame, focal_col="focal", neighbor_col="neighbor", weight_col="weight", nodes: DataFrame | None = None) -> Graph:
        return cls(df.select(F.col(focal_col).alias("focal"), F.col(neighbor_col).alias("neighbor"), F.col(weight_col).alias("weight")), nodes)

    @classmethod
    def from_dicts(cls, spark: SparkSession, neighbors: dict, weights: dict | None = None) -> Graph:
        rows = [(i, list(js or []), [float(x) for x in (weights[i] if weights else [1.0] * len(js or []))]) for i, js in neighbors.items()]
        kind = "bigint" if all(isinstance(i, int) for i in neighbors) else "string"
        df = spark.createDataFrame(rows, f"focal {kind}, ns array<{kind}>, ws array<double>")
        e = df.select("focal", F.explode_outer(F.arrays_zip("ns", "ws")).alias("p"))
        return cls(e.select("focal", F.coalesce("p.ns", "focal").alias("neighbor"), F.coalesce("p.ws", F.lit(0.0)).alias("weight")))

    @classmethod
    def from_weights_dict(cls, spark: SparkSession, weights: dict) -> Graph:
        return cls.from_dicts(spark, {i: list(d) for i, d in weights.items()}, {i: list(d.values()) for i, d in weights.items()})

    @classmethod
    def from_arrays(cls, spark: SparkSession, focal, neighbor, weight) -> Graph:
        kind = "bigint" if all(isinstance(i, int) for i in focal) else "string"
        return cls(spark.createDataFrame([(i, j, float(w)) for i, j, w in zip(focal, neighbor, weight, strict=True)], f"focal {kind}, neighbor {kind}, weight double"))

    @classmethod
    def from_dense(cls, rows: DataFrame) -> Graph:
        """``rows``: id (0 .. n-1) and values (array of n numbers)."""
        cells = rows.select(F.col("id").cast("bigint").alias("focal"), F.posexplode("values").alias("j", "weight")).filter("weight <> 0")
        return cls(cells.select("focal", F.col("j").cast("bigint").alias("neighbor"), "weight"), rows.select(F.col("id").cast("bigint").alias("id")))

    @classmethod
    def from_sparse(cls, cells: DataFrame, nodes: DataFrame) -> Graph:
        """``cells``: i, j, w by place; ``nodes``: ord and id."""
        a, b = nodes.select(F.col("ord").alias("i"), F.col("id").alias("focal")), nodes.select(F.col("ord").alias("j"), F.col("id").alias("neighbor"))
        return cls(cells.join(a, "i").join(b, "j").select("focal", "neighbor", F.col("w").alias("weight")), nodes)

    @classmethod
    def from_networkx(cls, spark: SparkSession, graph, weight: str | None = "weight") -> Graph:
        """From an object with the networkx interface: links of undirected graphs go both ways. ``weight`` None: 1."""
        rows = []
        for a, b, data in graph.edges(data=True):
            if weight is not None and weight not in data:
                raise ValueError(f"the link {a!r}, {b!r} has no {weight!r}")
            w = 1.0 if weight is None else float(data[weight])
            rows += [(a, b, w)] if graph.is_directed() or a == b else [(a, b, w), (b, a, w)]
        ids = list(graph.nodes)
        kind = "bigint" if all(isinstance(i, int) for i in ids) else "string"
        text = (lambda i: i) if kind == "bigint" else str
        e = spark.createDataFrame([(text(a), text(b), w) for a, b, w in rows], f"focal {kind}, neighbor {kind}, weight double")
        return cls(e, spark.createDataFrame([(text(i),) for i in ids], f"id {kind}"))

    def node_link(self) -> dict:
        """The graph as the dictionary of the node-link exchange format; made on the driver, for small graphs."""
        e = [r.asDict() for r in self.links().orderBy("focal", "neighbor").collect()]
        return {
            "directed": not self.asymmetry().isEmpty(), "multigraph": False, "graph": {},
            "nodes": [{"id": r["id"]} for r in self.unique_ids().collect()], "links": [{"source": r["focal"], "target": r["neighbor"], "weight": r["weight"]} for r in e],
        }

    def to_networkx(self):
        """A networkx graph (directed if weights differ between directions); needs that library."""
        import networkx

        data = self.node_link()
        out = networkx.DiGraph() if data["directed"] else networkx.Graph()
        out.add_nodes_from(n["id"] for n in data["nodes"])
        out.add_weighted_edges_from((x["source"], x["target"], x["weight"]) for x in data["links"])
        return out

    def _like(self, edges: DataFrame, transformation: str | None = None) -> Graph:
        return Graph(edges, self.nodes, transformation or "O")

    def to_dense(self) -> DataFrame:
        """id and one column a neighbor: only for small graphs."""
        return self.edges.groupBy(F.col("focal").alias("id")).pivot("neighbor").agg(F.sum("weight")).na.fill(0.0)

    def to_sparse(self) -> DataFrame:
        """i, j, w by the place of each id in the order of ids."""
        place = numbered(self.nodes)
        e = self.edges.filter("weight <> 0")
        return e.join(place.select(F.col("id").alias("focal"), F.col("ord").alias("i")), "focal").join(place.select(F.col("id").alias("neighbor"), F.col("ord").alias("j")), "neighbor").select("i", "j", F.col("weight").alias("w"))

    # views

    def links(self) -> DataFrame:
        """Edges without the placeholders of isolates."""
        return self.edges.filter("NOT (focal = neighbor AND weight = 0)")

    def neighbors(self) -> DataFrame:
        pair = F.sort_array(F.collect_list(F.when(~((F.col("focal") == F.col("neighbor")) & (F.col("weight") == 0)), F.struct("neighbor", "weight"))))
        return self.edges.groupBy(F.col("focal").alias("id")).agg(pair.alias("p")).select("id", F.col("p.neighbor").alias("neighbors"), F.col("p.weight").alias("weights"))

    def __getitem__(self, item) -> DataFrame:
        return self.links().filter(F.col("focal") == F.lit(item)).select("neighbor", "weight")

    def cardinalities(self) -> DataFrame:
        return self.edges.groupBy(F.col("focal").alias("id")).agg(F.count_if(F.col("weight") != 0).alias("cardinality"))

    def isolates(self) -> DataFrame:
        return self.cardinalities().filter("cardinality = 0").select("id")

    def unique_ids(self) -> DataFrame:
        return self.nodes.orderBy("id")

    def properties(self) -> DataFrame:
        """One row: n, n_edges, nonzero, pct_nonzero, n_isolates, max/min/mean cardinality and its histogram's ends."""
        per = self.edges.groupBy("focal").agg(F.count_if(F.col("weight") != 0).alias("c"), F.count_if(F.col("weight") > 0).alias("p"), F.count(F.lit(1)).alias("r"))
        total = per.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("rows"), F.sum("p").alias("nonzero"), F.count_if(F.col("c") == 0).alias("n_isolates"), F.max("c").alias("max_neighbors"), F.min("c").alias("min_neighbors"), F.avg("c").alias("mean_neighbors"))
        return total.select("n", (F.col("rows") - F.col("n_isolates")).alias("n_edges"), "nonzero", (100.0 * F.col("rows") / (F.col("n") * F.col("n"))).alias("pct_nonzero"), "n_isolates", "max_neighbors", "min_neighbors", "mean_neighbors")

    def histogram(self) -> DataFrame:
        """cardinality, count for every whole number from the least to the greatest."""
        c = self.cardinalities().groupBy("cardinality").agg(F.count(F.lit(1)).alias("count"))
        all_ = c.agg(F.explode(F.sequence(F.min("cardinality"), F.max("cardinality"))).alias("cardinality"))
        return all_.join(c, "cardinality", "left").select("cardinality", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))

    # transformations

    def transform(self, kind: str | Callable[[Column, list[str]], Column]) -> Graph:
        """R, D, B, V, or a function of the weight column and the partition columns (a window expression)."""
        w = F.col("weight")
        if callable(kind):
            return self._like(self.edges.withColumn("weight", kind(w, ["focal"])), "C")
        kind = kind.upper()
        if kind == self.transformation:
            return self
        if kind == "R":
            total = self.edges.groupBy("focal").agg(F.sum("weight").alias("_t"))  # joined, as a window would sort a hub in one task
            return self._like(self.edges.join(total, "focal").select("focal", "neighbor", F.coalesce(F.try_divide(w, F.col("_t")), F.lit(0.0)).alias("weight")), "R")
        if kind == "B":
            return self._like(self.edges.withColumn("weight", F.when(w != 0, 1.0).otherwise(0.0)), "B")
        if kind == "D":
            total = self.edges.agg(F.sum("weight").alias("_t"))  # one row
            return self._like(self.edges.crossJoin(F.broadcast(total)).select("focal", "neighbor", F.try_divide(w, F.col("_t")).alias("weight")), "D")
        if kind == "V":
            norm = self.edges.groupBy("focal").agg(F.sqrt(F.sum(w * w)).alias("_q"))
            s = self.edges.join(norm, "focal").select("focal", "neighbor", F.coalesce(F.try_divide(w, F.col("_q")), F.lit(0.0)).alias("weight"))
            total = s.groupBy("focal").agg(F.sum("weight").alias("s")).agg(F.sum("s").alias("_t"), F.count(F.lit(1)).alias("_n"))  # one row
            return self._like(s.crossJoin(F.broadcast(total)).select("focal", "neighbor", (w * F.try_divide(F.col("_n"), F.col("_t"))).alias("weight")), "V")
        raise ValueError(f"transformation {kind!r} is not supported; use one of {', '.join(TRANSFORMATIONS[1:5])} or a function")

    # lag and neighborhood statistics

    def lag(self, y: DataFrame, value: str = "y", categorical: bool | None = None, ties: str = "raise", seed: int = 0) -> DataFrame:
        """id and lag. y: id and ``value``. Text and boolean values give the most frequent label of the neighbors.
        ties: raise; lowest; tryself (the own label breaks a tie, then the lowest); random (by a hash of the id, the label
        and ``seed``, so the same seed gives the same labels)."""
        if ties not in ("raise", "lowest", "tryself", "random"):
            raise ValueError("ties must be raise, lowest, tryself or random")
        if categorical is None:
            categorical = dict(y.dtypes)[value] in ("string", "boolean")
        v = y.select(F.col("id").alias("neighbor"), F.col(value).alias("y"))
        joined = self.edges.join(v, "neighbor", "left")
        if not categorical:
            return joined.groupBy(F.col("focal").alias("id")).agg(F.sum(F.col("weight") * F.col("y")).alias("lag"))
        own = y.select(F.col("id").alias("focal"), F.col(value).alias("own"))
        tally = joined.groupBy("focal", "y").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("focal") == F.col("neighbor")).cast("int")).alias("has_self"))
        top = tally.groupBy("focal").agg(F.max("n").alias("n"), F.max("has_self").alias("has_self"))
        best = tally.select("focal", "y", "n").join(top, ["focal", "n"]).join(own, "focal", "left")
        score = F.when((F.col("y") == F.col("own")) & (F.col("has_self") == 0), 0).otherwise(1) if ties == "tryself" else F.xxhash64(F.lit(seed), "focal", "y") if ties == "random" else F.lit(0)
        out = best.groupBy(F.col("focal").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(score.alias("s"), "y")).alias("m"))
        if ties == "raise":
            stop = F.raise_error(F.lit("there are ties; choose another way with ties=")).cast(dict(y.dtypes)[value])
            return out.select("id", F.when(F.col("k") > 1, stop).otherwise(F.col("m.y")).alias("lag"))
        return out.select("id", F.col("m.y").alias("lag"))

    def describe(self, y: DataFrame, value: str = "y", q: tuple[float, float] | None = None, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
        """Statistics of neighbor values by id; null for isolates. q: keep values between two percentiles of each
        neighborhood of more than two values, ends included."""
        v = y.select(F.col("id").alias("neighbor"), F.col(value).cast("double").alias("y"))
        links = self.edges.join(v, "neighbor", "left")
        links = links.withColumn("live", F.sum((F.col("weight") != 0).cast("int")).over(W.partitionBy("focal")) > 0)
        kept = links.filter("live")
        if q is not None:
            lo, hi = (F.percentile("y", F.lit(p / 100)).over(W.partitionBy("focal")) for p in q)
            kept = kept.withColumns({"lo": lo, "hi": hi, "n": F.count("y").over(W.partitionBy("focal"))}).filter((F.col("n") <= 2) | F.col("y").between(F.col("lo"), F.col("hi")))
        agg = {"count": F.count("y"), "mean": F.avg("y"), "median": F.median("y"), "std": F.stddev_samp("y"), "min": F.min("y"), "max": F.max("y"), "sum": F.sum("y"), "nunique": F.count_distinct("y"), "mode": F.mode("y", True)}
        got = kept.groupBy(F.col("focal").alias("id")).agg(*[agg[s].alias(s) for s in statistics])
        return self.nodes.join(got, "id", "left")

    def aggregate(self, *columns: Column) -> DataFrame:
        """Any aggregates over the weights of each focal."""
        return self.links().groupBy(F.col("focal").alias("id")).agg(*columns)

    def apply(self, y: DataFrame, *columns: Column) -> DataFrame:
        """Any aggregates over the neighbors' rows of ``y`` (by id) and the weights of each focal."""
        return self.edges.join(y.withColumnRenamed("id", "neighbor"), "neighbor", "left").groupBy(F.col("focal").alias("id")).agg(*columns)

    def apply_in_pandas(self, y: DataFrame, func, schema: str) -> DataFrame:
        """A function from a pandas frame of one neighborhood to a frame, for reducers that columns can't express."""
        return self.edges.join(y.withColumnRenamed("id", "neighbor"), "neighbor", "left").groupBy("focal").applyInPandas(func, schema)

    # shape

    def eliminate_zeros(self) -> Graph:
        return Graph(self.edges.filter("weight <> 0"), self.nodes, self.transformation)

    def assign_self_weight(self, weight: float | DataFrame = 1.0) -> Graph:
        """One weight for all, or a DataFrame (id, weight)."""
        rest = self.edges.filter("focal <> neighbor")
        own = weight if isinstance(weight, DataFrame) else self.nodes.withColumn("weight", F.lit(float(weight)))
        return self._like(rest.unionByName(own.select(F.col("id").alias("focal"), F.col("id").alias("neighbor"), F.col("weight").cast("double").alias("weight"))))

    def subgraph(self, ids: DataFrame) -> Graph:
        inside = self.links().join(ids.select(F.col("id").alias("focal")), "focal", "left_semi").join(ids.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
        return Graph(inside, ids.select("id"), self.transformation)

    def _transposed(self) -> DataFrame:
        return self.edges.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), F.col("weight").alias("back"))

    def asymmetry(self, intrinsic: bool = True) -> DataFrame:
        """Ordered pairs whose weights (or, if not intrinsic, whose presence) differ in the two directions."""
        w = F.col("weight") if intrinsic else (F.col("weight") != 0).cast("double")
        e = self.edges.select("focal", "neighbor", w.alias("weight"))
        t = e.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), F.col("weight").alias("back"))
        both = e.join(t, ["focal", "neighbor"], "full")
        return both.filter(F.coalesce("weight", F.lit(0.0)) != F.coalesce("back", F.lit(0.0))).select("focal", "neighbor")

    def make_symmetric(self, intersection: bool = False, reduction: str | None = None) -> Graph:
        w, b = F.col("weight"), F.col("back")
        joins = {"sum": w + b, "min": F.least(w, b), "max": F.greatest(w, b), "mean": (w + b) / 2}
        if reduction is not None and reduction not in joins:
            raise ValueError(f"reduction must be one of {', '.join(joins)}")
        stop = F.raise_error(F.lit("weights of a pair differ; give a reduction")).cast("double")
        e = self.links().join(self._transposed().filter("NOT (focal = neighbor AND back = 0)"), ["focal", "neighbor"], "inner" if intersection else "full")
        merged = F.when(F.col("focal") == F.col("neighbor"), w).when(w.isNull(), b).when(b.isNull(), w).when(w == b, w).otherwise(joins[reduction] if reduction else stop)
        return self._like(e.select("focal", "neighbor", merged.alias("weight")))

    def higher_order(self, k: int = 2, shortest_path: bool = True, diagonal: bool = False, lower_order: bool = False) -> Graph:
        """Pairs that k steps join (and no fewer, if shortest_path); lower_order: that 1 to k steps join. Weight 1."""
        from ..scratch import write

        step, _ = write(self.edges.filter("weight <> 0").select("focal", "neighbor").distinct())
        walks = [step]
        for _ in range(k - 1):
            w = walks[-1].select("focal", F.col("neighbor").alias("via")).join(step.select(F.col("focal").alias("via"), "neighbor"), "via").select("focal", "neighbor").distinct()
            walks.append(write(w)[0])
        if lower_order:
            out = walks[0]
            for w in walks[1:]:
                out = out.unionByName(w)
            out = out.distinct()
        else:
            out = walks[-1]
            for w in walks[:-1] if shortest_path else []:
                out = out.join(w, ["focal", "neighbor"], "left_anti")
        if not diagonal:
            out = out.filter("focal <> neighbor")
        return self._like(out.withColumn("weight", F.lit(1.0)))

    def component_labels(self) -> DataFrame:
        return paths.component_labels(self.nodes, self.edges)

    def n_components(self) -> DataFrame:
        return self.component_labels().agg(F.count_distinct("component").alias("n_components"))

    def order(self, kmax: int = 3) -> DataFrame:
        """hops up to kmax of all pairs that reach each other."""
        return paths.hops(self.nodes, self.edges, kmax)

    def shimbel(self) -> DataFrame:
        return paths.hops(self.nodes, self.edges)

    def local_clustering(self) -> DataFrame:
        """id and the share of links among its neighbors; null where there is one neighbor, 0 for isolates."""
        n = self.edges.filter("weight <> 0 AND focal <> neighbor").select("focal", "neighbor")
        # a link u -> v closes the pair (u, v) of each focal that is linked to both: found from the end with fewer focals,
        # so a hub's pairs are never made
        held = n.groupBy(F.col("neighbor").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        e = n.toDF("u", "v").join(held.toDF("u", "du"), "u").join(held.toDF("v", "dv"), "v")
        few = F.col("du") <= F.col("dv")
        e = e.select(F.when(few, F.col("u")).otherwise(F.col("v")).alias("neighbor"), F.when(few, F.col("v")).otherwise(F.col("u")).alias("other"))
        both = e.join(n, "neighbor").select("focal", F.col("other").alias("neighbor")).filter("focal <> neighbor").join(n, ["focal", "neighbor"])
        closed = both.groupBy("focal").agg(F.count(F.lit(1)).alias("links"))
        k = n.groupBy("focal").agg(F.count(F.lit(1)).alias("k"))
        out = self.nodes.join(k.join(closed, "focal", "left").withColumnRenamed("focal", "id"), "id", "left")
        share = F.coalesce("links", F.lit(0)).cast("double") / F.when(F.col("k") > 1, F.col("k") * (F.col("k") - 1))
        return out.select("id", F.when(F.col("k").isNull(), 0.0).otherwise(share).alias("clustering"))

    # moments

    def summary(self) -> DataFrame:
        """One row: s0, s1, s2 and the sums of the diagonals of GG, G'G and both."""
        w, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("back", F.lit(0.0))
        cells = self.edges.join(self._transposed(), ["focal", "neighbor"], "full").select(w.alias("w"), b.alias("b"))
        a = cells.agg(F.sum("w").alias("s0"), (F.sum((F.col("w") + F.col("b")) * (F.col("w") + F.col("b"))) / 2).alias("s1"), F.sum(F.col("w") * F.col("b")).alias("trace_gg"), F.sum(F.col("b") * F.col("b")).alias("trace_gtg"))
        per = self.edges.select(F.col("focal").alias("id"), "weight").unionByName(self.edges.select(F.col("neighbor").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("t"))
        s2 = per.agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
        return a.crossJoin(F.broadcast(s2)).withColumn("trace_gtg_gg", F.col("trace_gg") + F.col("trace_gtg"))  # one row each

    def diagonals(self) -> DataFrame:
        """id, diag_gg, diag_gtg and s2 (row sum plus column sum, squared) of every node."""
        gg = self.edges.join(self._transposed(), ["focal", "neighbor"]).groupBy(F.col("focal").alias("id")).agg(F.sum(F.col("weight") * F.col("back")).alias("diag_gg"), F.lit(0).alias("_"))
        col = self.edges.groupBy(F.col("neighbor").alias("id")).agg(F.sum(F.col("weight") * F.col("weight")).alias("diag_gtg"), F.sum("weight").alias("c"))
        row = self.edges.groupBy(F.col("focal").alias("id")).agg(F.sum("weight").alias("r"))
        out = self.nodes.join(gg.drop("_"), "id", "left").join(col, "id", "left").join(row, "id", "left").na.fill(0.0)
        return out.select("id", "diag_gg", "diag_gtg", ((F.col("r") + F.col("c")) * (F.col("r") + F.col("c"))).alias("s2"))

    def distribution(self) -> DataFrame:
        """Moments and quartiles of cardinalities and of weights (isolates' placeholders left out)."""
        one = lambda df, c, what: df.agg(F.lit(what).alias("what"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max(c).cast("double").alias("max"))
        return one(self.cardinalities(), "cardinality", "cardinality").unionByName(one(self.links(), "weight", "weight"))

    def diag_gtg_gg(self) -> DataFrame:
        """id and diag: the diagonal of G'G + GG."""
        return self.diagonals().select("id", (F.col("diag_gg") + F.col("diag_gtg")).alias("diag"))

    def report(self) -> str:
        """A text of the graph's size, cardinalities, weights, sums and traces."""
        one = self.properties().first().asDict() | self.summary().first().asDict()
        one |= {"n_components": self.n_components().first()[0], "n_asymmetries": self.asymmetry().count()}
        spread = {r["what"]: r.asDict() for r in self.distribution().collect()}
        line = lambda name, x: f"{name:<34}{x if isinstance(x, str) else f'{x:,.4g}' if isinstance(x, float) else x:>16}"
        out = ["Graph", "=" * 50]
        out += [line(n, one[k]) for n, k in (("nodes", "n"), ("links", "n_edges"), ("components", "n_components"), ("isolates", "n_isolates"), ("links over 0", "nonzero"), ("percent of pairs", "pct_nonzero"), ("asymmetries", "n_asymmetries"))]
        for what, title in (("cardinality", "Cardinalities"), ("weight", "Weights")):
            out += [title, "-" * 50, *[line(k, v) for k, v in spread[what].items() if k != "what"]]
        out += ["Sums and traces", "-" * 50, *[line(k, one[k]) for k in ("s0", "s1", "s2", "trace_gg", "trace_gtg", "trace_gtg_gg")]]
        return "\n".join(out)

    def edge_lines(self, points: DataFrame, focal=None) -> DataFrame:
        """focal, neighbor, weight and the ends of each link (x0, y0, x1, y1), for a map or plot; of one focal id or all."""
        links = self.links() if focal is None else self.links().filter(F.col("focal") == F.lit(focal))
        at = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        return links.join(at.toDF("focal", "x0", "y0"), "focal").join(at.toDF("neighbor", "x1", "y1"), "neighbor")

    def plot(self, points: DataFrame, focal=None, width: int = 600, nodes: bool = True, most: int = 100_000) -> str:
        """An SVG picture of the links between points; made on the driver, so ``most`` links at most."""
        lines = self.edge_lines(points, focal)
        if lines.count() > most:
            raise ValueError(f"over {most} links; draw a subgraph, or use edge_lines()")
        rows, dots = lines.collect(), points.collect()
        if not dots:
            return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}"/>'
        left, low = min(p["x"] for p in dots), min(p["y"] for p in dots)
        scale = (width - 20) / max(max(p["x"] for p in dots) - left, max(p["y"] for p in dots) - low, 1e-12)
        at = lambda x, y: (round(10 + (x - left) * scale, 2), round(width - 10 - (y - low) * scale, 2))
        body = ["<line x1='{}' y1='{}' x2='{}' y2='{}'/>".format(*at(r["x0"], r["y0"]), *at(r["x1"], r["y1"])) for r in rows]
        body += ["<circle cx='{}' cy='{}' r='2'><title>{}</title></circle>".format(*at(p["x"], p["y"]), p["id"]) for p in dots if nodes]
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}" stroke="black">{"".join(body)}</svg>'

    def geojson(self, points: DataFrame, focal=None) -> DataFrame:
        """One GeoJSON feature (text) a link, for web maps."""
        r = self.edge_lines(points, focal)
        line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x0", "y0"), F.array("x1", "y1")).alias("coordinates"))
        return r.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct("focal", "neighbor", "weight").alias("properties"))).alias("feature"))

    explore = geojson

    # sets

    def isomorphic(self, other: Graph, most: int = 2000) -> bool:
        """Whether some renaming of nodes makes the graphs' links equal (weights aside). Colours refined in rounds decide; nodes that look
        alike to them are searched by components, in tasks, of which none may have over ``most`` such nodes."""
        from .colours import isomorphic

        plain = [g.links().select("focal", "neighbor").distinct() for g in (self, other)]
        if self.nodes.count() != other.nodes.count():
            return False
        return isomorphic(tuple(plain), (self.nodes, other.nodes), most, _matched)

    def __len__(self) -> int:
        return self.links().count()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Graph) and self.equals(other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        return True

    def to_grid(self, cells: DataFrame, y: DataFrame, nodata: float | None = None, value: str = "y") -> DataFrame:
        """row, col and value of every cell between the least and greatest row and column; cells without data get ``nodata``."""
        box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        full = box.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
        held = cells.select("id", "row", "col").join(y.select("id", F.col(value).alias("value")), "id").select("row", "col", "value")
        return full.join(held, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(nodata)).alias("value") if nodata is not None else F.col("value"))

    def intersects(self, other: Graph) -> bool:
        return not self._common(other).isEmpty()

    def among(self, links: DataFrame) -> DataFrame:
        """Those of ``links`` that the graph has."""
        return links.join(self.links(), ["focal", "neighbor"], "left_semi")

    def _common(self, other: Graph) -> DataFrame:
        return self.among(other.links()) if self.tells else other.among(self.links())

    def _binary(self, pairs: DataFrame) -> Graph:
        return self._like(pairs.select("focal", "neighbor").withColumn("weight", F.lit(1.0)))

    def intersection(self, other: Graph) -> Graph:
        return self._binary(self._common(other))

    def difference(self, other: Graph) -> Graph:
        return self._binary(self.links().join(other.links(), ["focal", "neighbor"], "left_anti"))

    def _same_nodes(self, other: Graph) -> None:
        if not self.nodes.exceptAll(other.nodes).isEmpty() or not other.nodes.exceptAll(self.nodes).isEmpty():
            raise ValueError("the graphs have different nodes")

    def union(self, other: Graph) -> Graph:
        self._same_nodes(other)
        return self._binary(self.links().select("focal", "neighbor").unionByName(other.links().select("focal", "neighbor")).distinct())

    def symmetric_difference(self, other: Graph) -> Graph:
        self._same_nodes(other)
        mine, theirs = self.links().select("focal", "neighbor"), other.links().select("focal", "neighbor")
        return self._binary(mine.join(theirs, ["focal", "neighbor"], "left_anti").unionByName(theirs.join(mine, ["focal", "neighbor"], "left_anti")))

    def issubgraph(self, other: Graph) -> bool:
        return self.links().join(other.links(), ["focal", "neighbor"], "left_anti").isEmpty()

    def equals(self, other: Graph) -> bool:
        """Graphs of unequal size are told apart by their counts, without a shuffle of all edges."""
        if self.edges.count() != other.edges.count():
            return False
        return self.edges.exceptAll(other.edges).isEmpty()

    def clip(self, mask: Graph) -> Graph:
        """Weights where the mask has a link."""
        return self._like(self.links().join(mask.links(), ["focal", "neighbor"], "left_semi"))

    __and__, __or__, __xor__, __sub__ = intersection, union, symmetric_difference, difference
    __le__ = issubgraph

    def __ge__(self, other: Graph) -> bool:
        return other <= self

    def __lt__(self, other: Graph) -> bool:
        return self <= other and not other <= self

    def __gt__(self, other: Graph) -> bool:
        return other < self

    def remap(self, names: DataFrame) -> Graph:
        """``names``: id and new_id, one row a node."""
        a, b = names.select(F.col("id").alias("focal"), F.col("new_id").alias("f")), names.select(F.col("id").alias("neighbor"), F.col("new_id").alias("n"))
        return Graph(self.edges.join(a, "focal").join(b, "neighbor").select(F.col("f").alias("focal"), F.col("n").alias("neighbor"), "weight"), names.select(F.col("new_id").alias("id")))


def _matched(first: tuple[list, dict], second: tuple[list, dict]) -> bool:
    """Whether the nodes of two small graphs, each (links, colours), can be paired so that colours and links agree."""
    colours, sets = [first[1], second[1]], []
    for links, nodes in (first, second):
        to, back = {i: set() for i in nodes}, {i: set() for i in nodes}
        for a, b in links:
            to[a].add(b)
            back[b].add(a)
        sets.append((to, back))
    many: dict = {}
    for c in colours[0].values():
        many[c] = many.get(c, 0) + 1
    order = sorted(colours[0], key=lambda i: (many[colours[0][i]], str(i)))
    image: dict = {}
    used: set = set()
    stack = [iter([j for j in colours[1] if colours[1][j] == colours[0][order[0]]])] if order else []
    while stack:
        i = order[len(stack) - 1]
        used.discard(image.pop(i, None))
        for j in stack[-1]:
            fits = j not in used and (i in sets[0][0][i]) == (j in sets[1][0][j])
            if fits and all((a in sets[0][k][i]) == (b in sets[1][k][j]) for a, b in image.items() for k in (0, 1)):
                image[i] = j
                used.add(j)
                break
        else:
            stack.pop()
            continue
        if len(image) == len(order):
            return True
        nxt = order[len(stack)]
        stack.append(iter([j for j in colours[1] if colours[1][j] == colours[0][nxt]]))
    return not order


class BlockGraph(Graph):
    """Complete graph within each regime. Its edges grow with the square of a regime, so what sums can answer never
    makes them: lag, cardinalities and row standardisation work on one row a regime."""

    def __init__(self, regimes: DataFrame, transformation: str = "O"):
        self.regimes = regimes.select("id", "regime")
        self.nodes = self.regimes.select("id")
        self.transformation = transformation
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            a, b = self.regimes.select(F.col("id").alias("focal"), "regime"), self.regimes.select(F.col("id").alias("neighbor"), "regime")
            w = F.lit(1.0)
            pairs = a.join(b, "regime").filter("focal <> neighbor")
            if self.transformation == "R":
                pairs = pairs.join(self._sizes(), "regime")
                w = 1 / (F.col("n") - 1)
            self._edges = with_isolates(pairs.select("focal", "neighbor", w.alias("weight")), self.nodes)
        return self._edges

    def _sizes(self) -> DataFrame:
        return self.regimes.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))

    def transform(self, kind) -> Graph:
        if not callable(kind) and kind.upper() in ("R", "B"):
            return self if kind.upper() == self.transformation else BlockGraph(self.regimes, kind.upper())
        return Graph(self.edges, self.nodes).transform(kind)

    def cardinalities(self) -> DataFrame:
        alone = self.regimes.filter("regime IS NULL").select("id", F.lit(0).cast("bigint").alias("cardinality"))
        return self.regimes.join(self._sizes(), "regime").select("id", (F.col("n") - 1).alias("cardinality")).unionByName(alone)

    def lag(self, y: DataFrame, value: str = "y", categorical: bool | None = None, ties: str = "raise") -> DataFrame:
        if categorical or (categorical is None and dict(y.dtypes)[value] in ("string", "boolean")):
            return super().lag(y, value, True, ties)
        own = self.regimes.join(y.select("id", F.col(value).cast("double").alias("y")), "id", "left")
        total = own.groupBy("regime").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
        others = F.coalesce("s", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
        if self.transformation == "R":
            others = others / F.when(F.col("n") > 1, F.col("n") - 1)
        return own.join(total, "regime", "left").select("id", F.when(F.col("n") > 1, others).otherwise(0.0).alias("lag"))
