"""Whether two graphs are the same up to the names of their nodes, by refining colours in rounds.

A node's next colour is a hash of its own and of sums over the colours that its links lead to and come from; sums of hashes need no
list of a hub's neighbors. Equal graphs have equal counts of colours in every round. If the colours tell all nodes apart they
are the renaming, and one join of the links decides; else only nodes whose colour others share, with the links among them, go to
a search. That goes by components, each in a task: the graphs are the same if each kind of component is as often in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, write
from .paths import component_labels

_HALF = 1 << 31


def _sums(links: DataFrame, colours: DataFrame, own: str, other: str) -> DataFrame:
    """id with the number and two sums of the hashed colours of the nodes at the links' other ends."""
    h = lambda k: F.sum(F.pmod(F.xxhash64(F.lit(k), "colour"), F.lit(_HALF)))  # noqa: E731  sums stay exact for 2 ** 32 links
    at = links.select(F.col(own).alias("node"), F.col(other).alias("id")).join(colours, "id")
    return at.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{own}"), h(1).alias(f"a_{own}"), h(2).alias(f"b_{own}"))


def refined(links: DataFrame, nodes: DataFrame, rounds: int = 64):
    """Yields (colours, path, number of colours) of each round, from one colour of all on. ``links``: focal, neighbor."""
    loop = links.filter("focal = neighbor").select(F.col("focal").alias("id"), F.lit(2).alias("loop")).distinct()
    colours, path = write(nodes.select("id").join(loop, "id", "left").select("id", F.xxhash64(F.coalesce("loop", F.lit(1))).alias("colour")))
    for _ in range(rounds):
        yield colours, path, colours.agg(F.count_distinct("colour")).first()[0]
        out = colours.join(_sums(links, colours, "focal", "neighbor"), "id", "left").join(_sums(links, colours, "neighbor", "focal"), "id", "left")
        parts = [F.coalesce(f"{k}_{c}", F.lit(0)) for c in ("focal", "neighbor") for k in "nab"]
        new, new_path = write(out.select("id", F.xxhash64("colour", *parts).alias("colour")))
        colours, path = new, new_path


def _components(links: DataFrame, colours: DataFrame) -> DataFrame:
    """look, nodes and links of each component of the coloured nodes; components of one look have like colours and as many links."""
    among = links.join(colours.select(F.col("id").alias("focal")), "focal", "left_semi").join(colours.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    at = component_labels(colours, among.withColumn("weight", F.lit(1.0)))
    held = colours.join(at, "id").groupBy("component").agg(F.collect_list(F.struct("id", "colour")).alias("nodes"))
    among = among.join(at.withColumnRenamed("id", "focal"), "focal").groupBy("component").agg(F.collect_list(F.struct("focal", "neighbor")).alias("links"))
    rows = held.join(among, "component", "left").withColumn("links", F.coalesce("links", F.array().cast(dict(among.dtypes)["links"])))
    return rows.select(F.xxhash64(F.sort_array(F.transform("nodes", lambda v: v["colour"])), F.size("links")).alias("look"), "nodes", "links")


def _alike(search):
    """A column function: whether two components are the same up to names. Nodes paired in order of colours are tried before a search."""

    def alike(nodes, links, other_nodes, other_links):
        one, two = ([tuple(r) for r in x] for x in (links, other_links))
        a, b = ({r["id"]: r["colour"] for r in x} for x in (nodes, other_nodes))
        if sorted(a.values()) != sorted(b.values()) or len(one) != len(two):
            return False
        to = dict(zip(sorted(a, key=a.get), sorted(b, key=b.get), strict=True))
        return {(to[i], to[j]) for i, j in one} == set(two) or search((one, a), (two, b))

    return F.udf(alike, "boolean")


def _same_parts(first: DataFrame, second: DataFrame, search, spent: list) -> bool:
    """Whether each kind of component is as often in both. A round compares all of one look to one of them, and those unlike it go on."""
    sides, tasks = [first, second], int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one look may be all rows
    while True:
        counts = [x.groupBy("look").agg(F.count(F.lit(1)).alias("n")) for x in sides]
        if not counts[0].join(counts[1].withColumnRenamed("n", "m"), "look", "full").filter("n IS NULL OR m IS NULL OR n <> m").isEmpty():
            return False
        if sides[0].isEmpty():
            return True
        one, path = write(sides[0].groupBy("look").agg(F.first(F.struct("nodes", "links")).alias("one")))
        spent.append(path)
        like = _alike(search)("nodes", "links", "one.nodes", "one.links")
        marked = []
        for x in sides:
            rows, path = write(x.join(one, "look").repartition(tasks).select("look", "nodes", "links", like.alias("like")))
            spent.append(path)
            marked.append(rows)
        same = [x.filter("like").groupBy("look").agg(F.count(F.lit(1)).alias("n")) for x in marked]
        if not same[0].join(same[1].withColumnRenamed("n", "m"), "look", "full").filter("n IS NULL OR m IS NULL OR n <> m").isEmpty():
            return False
        sides = [x.filter("NOT like").select("look", "nodes", "links") for x in marked]


def isomorphic(links: tuple[DataFrame, DataFrame], nodes: tuple[DataFrame, DataFrame], most: int, search) -> bool:
    """search: decides for two small graphs, given as (links, colours of the nodes), whether colours and links can agree."""
    spark, spent, before = links[0].sparkSession, [], 0
    try:
        for (c0, p0, k0), (c1, p1, k1) in zip(*(refined(x, n) for x, n in zip(links, nodes, strict=True)), strict=True):
            spent += [p0, p1]
            counts = [c.groupBy("colour").agg(F.count(F.lit(1)).alias("n")) for c in (c0, c1)]
            differ = counts[0].join(counts[1].withColumnRenamed("n", "m"), "colour", "full").filter("n IS NULL OR m IS NULL OR n <> m")
            if k0 != k1 or not differ.isEmpty():
                return False
            if k0 == before:
                break
            before = k0
        named = []
        for x, c in zip(links, (c0, c1), strict=True):
            ends = x.join(c.toDF("focal", "cf"), "focal").join(c.toDF("neighbor", "cn"), "neighbor")
            named.append(ends.groupBy("cf", "cn").agg(F.count(F.lit(1)).alias("n")))
        if not named[0].join(named[1].withColumnRenamed("n", "m"), ["cf", "cn"], "full").filter("n IS NULL OR m IS NULL OR n <> m").isEmpty():
            return False
        shared = counts[0].filter("n > 1").select("colour")
        left = [c.join(shared, "colour", "left_semi") for c in (c0, c1)]
        n = left[0].count()
        if not n:
            return True
        parts = []
        for x, c in zip(links, left, strict=True):
            part, path = write(_components(x, c))
            spent.append(path)
            most_alike = part.agg(F.max(F.size("nodes"))).first()[0] or 0
            if most_alike > most:
                raise ValueError(f"{most_alike} nodes can't be told apart by their links; a search is for {most} at most")
            parts.append(part)
        return _same_parts(*parts, search, spent)
    finally:
        for path in spent:
            remove(spark, path)
