"""Graphs of flows that share ends, without their edges.

Two links are neighbors if an end of one is an end of the other. At a node of many links that makes the square of their number, so
``FlowGraph`` keeps the links, and answers lag, cardinalities and row standardisation by sums over nodes: the links with an
origin in a set A or a destination in a set B are those by origin, and those by destination, less those that are both. Each
link asks for eight sums at most, and each sum is a row of a table aggregated once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph

#: Ends of the link itself that a neighbor's origin, and destination, may be.
SHARES = {"O": ("o", ""), "D": ("", "d"), "OD": ("o", "d"), "C": ("d", ""), "A": ("od", "od")}


def joined_links(links: DataFrame, share: str) -> DataFrame:
    """focal, neighbor of all links that share ends: by its nature the square of the links at a node."""
    origins, destinations = SHARES[share]
    out = []
    for mine, theirs in [*((m, "o") for m in origins), *((m, "d") for m in destinations)]:
        a, b = links.select(F.col("id").alias("focal"), F.col(mine).alias("at")), links.select(F.col("id").alias("neighbor"), F.col(theirs).alias("at"))
        out.append(a.join(b, "at").filter("focal <> neighbor").select("focal", "neighbor"))
    return reduce(DataFrame.unionByName, out).distinct()


class FlowGraph(Graph):
    """links: id, o, d. Other links with the same origin (O), destination (D), either (OD), that begin where this one ends (C), or
    with any end in common (A). Null ends are shared with nothing."""

    def __init__(self, links: DataFrame, share: str = "A", transformation: str = "B"):
        self.share = share.upper()
        if self.share not in SHARES:
            raise ValueError("share must be O, D, OD, C or A")
        self.given = links.select("id", "o", "d")
        self.nodes = self.given.select("id")
        self.transformation = transformation
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            plain = Graph(joined_links(self.given, self.share).withColumn("weight", F.lit(1.0)), self.nodes)
            self._edges = (plain.transform("R") if self.transformation == "R" else plain).edges
        return self._edges

    def transform(self, kind) -> Graph:
        if not callable(kind) and kind.upper() in ("R", "B"):
            return self if kind.upper() == self.transformation else FlowGraph(self.given, self.share, kind.upper())
        return Graph(self.edges, self.nodes).transform(kind)

    def _asked(self) -> tuple[Column, Column]:
        """The origins, and the destinations, that make a link a neighbor: arrays without nulls and repeats."""
        ends = [F.array_distinct(F.filter(F.array(*map(F.col, x)), lambda v: v.isNotNull())) if x else None for x in SHARES[self.share]]
        kind = dict(self.given.dtypes)["o"]
        return tuple(F.array().cast(f"array<{kind}>") if e is None else e for e in ends)

    def sums(self, values: DataFrame) -> DataFrame:
        """id and total: of ``value`` over the neighbors of each link. values: id, value (missing ones count 0)."""
        own = self.given.join(values.select("id", F.col("value").cast("double").alias("value")), "id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        keys = ["kind", "o", "d"]
        tables = []
        for kind, o, d in ((0, "o", "o"), (1, "d", "d"), (2, "o", "d")):
            at = own.filter(F.col(o).isNotNull() & F.col(d).isNotNull()).select(F.lit(kind).alias("kind"), F.col(o).alias("o"), F.col(d).alias("d"), "value")
            tables.append(at.groupBy(*keys).agg(F.sum("value").alias("s")))
        totals = reduce(DataFrame.unionByName, tables)
        origins, destinations = self._asked()
        asked = own.withColumns({"a": origins, "b": destinations})
        key = lambda kind, o, d, sign: F.struct(F.lit(kind).alias("kind"), o.alias("o"), d.alias("d"), F.lit(sign).alias("sign"))
        each = F.concat(
            F.transform("a", lambda v: key(0, v, v, 1.0)), F.transform("b", lambda v: key(1, v, v, 1.0)),
            F.flatten(F.transform("a", lambda v: F.transform("b", lambda w: key(2, v, w, -1.0)))),
        )
        # a link is among its own neighbors where its ends are asked for, and is taken off
        self_too = F.coalesce(F.array_contains("a", F.col("o")), F.lit(False)) | F.coalesce(F.array_contains("b", F.col("d")), F.lit(False))
        asked = asked.withColumn("mine", F.when(self_too, F.col("value")).otherwise(0.0))
        found = asked.select("id", F.explode(each).alias("k")).select("id", "k.*").join(totals, keys).groupBy("id").agg(F.sum(F.col("sign") * F.col("s")).alias("s"))
        return asked.select("id", "mine").join(found, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) - F.col("mine")).alias("total"))

    def cardinalities(self) -> DataFrame:
        return self.sums(self.nodes.withColumn("value", F.lit(1.0))).select("id", F.round("total").cast("bigint").alias("cardinality"))

    def lag(self, y: DataFrame, value: str = "y", categorical: bool | None = None, ties: str = "raise", seed: int = 0) -> DataFrame:
        if categorical or (categorical is None and dict(y.dtypes)[value] in ("string", "boolean")):
            return super().lag(y, value, True, ties, seed)
        total = self.sums(y.select("id", F.col(value).alias("value")))
        if self.transformation != "R":
            return total.select("id", F.col("total").alias("lag"))
        both = total.join(self.cardinalities(), "id")
        return both.select("id", F.when(F.col("cardinality") > 0, F.col("total") / F.col("cardinality")).otherwise(0.0).alias("lag"))


def kron_lag(origins: Graph, destinations: Graph, flows: DataFrame, standardise: bool = True) -> DataFrame:
    """o, d and lag: the lag of ``flows`` (o, d, y; missing ones count 0) over the Kronecker product of two graphs' links, as a lag
    over destinations and then one over origins. The product's own edges, as many as the links of both multiplied, aren't made."""
    a, b = (g.transform("B").links().filter("weight <> 0").select("focal", "neighbor") for g in (origins, destinations))
    first = flows.join(b.toDF("to", "d"), "d").groupBy("o", F.col("to").alias("d")).agg(F.sum("y").alias("y"))
    second = first.join(a.toDF("to", "o"), "o").groupBy(F.col("to").alias("o"), "d").agg(F.sum("y").alias("lag"))
    if not standardise:
        return second
    n = [g.groupBy(F.col("focal").alias(c)).agg(F.count(F.lit(1)).alias(f"n_{c}")) for g, c in ((a, "o"), (b, "d"))]
    return second.join(n[0], "o").join(n[1], "d").select("o", "d", (F.col("lag") / (F.col("n_o") * F.col("n_d"))).alias("lag"))
