"""Flow graphs by sums against their edges, and isomorphism by colours against renamed graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import builders
from edgeloom.operators.flows import SHARES, FlowGraph, joined_links, kron_lag
from edgeloom.operators.graph import Graph


@pytest.fixture(scope="module")
def links(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice([1, 2, 5, 5, 6])) for k in range(60)]  # repeated links, loops, a hub
    return spark.createDataFrame([*rows, (60, None, 5), (61, 2, None), (62, 77, 78)], "id long, o long, d long").cache()


@pytest.mark.parametrize("share", SHARES)
def test_flow_sums_equal_edges(spark, links, share):
    y = links.select("id", (F.col("id") * 1.5).alias("y")).filter("id <> 7")
    flow = FlowGraph(links, share)
    plain = Graph(joined_links(links, share).withColumn("weight", F.lit(1.0)), links.select("id"))
    rows = lambda df: {r[0]: None if r[1] is None else round(r[1], 6) for r in df.collect()}
    y0 = y.unionByName(links.filter("id = 7").select("id", F.lit(0.0).alias("y")))
    assert rows(flow.lag(y)) == rows(plain.lag(y0))
    assert rows(flow.cardinalities()) == rows(plain.cardinalities())
    assert rows(flow.transform("R").lag(y)) == rows(plain.transform("R").lag(y0))
    assert "edges" not in vars(flow) and flow._edges is None
    assert sorted(map(tuple, flow.edges.collect())) == sorted(map(tuple, plain.edges.collect()))
    with pytest.raises(ValueError):
        FlowGraph(links, "X")


def test_hub_of_all_links(spark):
    """200,000 links from one node: their square isn't made."""
    hub = spark.range(200_000).select("id", F.lit(1).cast("long").alias("o"), (F.col("id") % 7).alias("d"))
    total = FlowGraph(hub, "OD").lag(hub.select("id", F.lit(1.0).alias("y"))).agg(F.min("lag"), F.max("lag")).first()
    assert tuple(total) == (199_999.0, 199_999.0)


def test_kron_lag_equals_the_product(spark):
    a, b = builders.lattice(spark, 2, 3), builders.lattice(spark, 3, 2, "queen")
    flows = spark.createDataFrame([(o, d, float(o * 7 + d)) for o in range(6) for d in range(6) if (o + d) % 4], "o long, d long, y double")
    product = builders.od_weights(a, b)
    y = flows.select(F.struct("o", "d").alias("id"), "y").unionByName(spark.createDataFrame([((o, d), 0.0) for o in range(6) for d in range(6) if not (o + d) % 4], "id struct<o:long,d:long>, y double"))
    want = {(r["id"]["o"], r["id"]["d"]): round(r["lag"] or 0, 9) for r in product.lag(y).collect()}
    got = {(r["o"], r["d"]): round(r["lag"], 9) for r in kron_lag(a, b, flows).collect()}
    assert {k: got.get(k, 0) for k in want} == want


def graph(spark, pairs, n):
    return Graph(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "focal long, neighbor long, weight double"), spark.range(n))


def test_isomorphic(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(120)}
    name = list(range(40))
    rng.shuffle(name)
    g, same = graph(spark, pairs, 40), graph(spark, {(name[a], name[b]) for a, b in pairs}, 40)
    one = next(iter(pairs))
    moved = (pairs - {one}) | {next((a, b) for a in range(40) for b in range(40) if (a, b) not in pairs and (a, b) != one)}
    assert g.isomorphic(same) and not g.isomorphic(graph(spark, moved, 40))
    two = graph(spark, [(a + s, (a + d) % 3 + s) for s in (0, 3) for a in range(3) for d in (1, 2)], 6)
    six = graph(spark, [(a, (a + d) % 6) for a in range(6) for d in (1, 5)], 6)
    assert not two.isomorphic(six) and six.isomorphic(six)  # alike to colours: the search decides
    with pytest.raises(ValueError, match="told apart"):
        six.isomorphic(two, most=3)


def test_isomorphic_of_many_nodes_without_a_search(spark):
    """100,000 nodes that colours tell apart: no search (``most`` is 0) and no collect, both for equal graphs and for one moved link."""
    n = 100_000

    def made(rename, moved):
        ends = F.array(*[F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n)) for k in range(3)])
        links = spark.range(n).select(F.col("id").alias("focal"), F.explode(ends).alias("neighbor"))
        if moved:
            links = links.withColumn("neighbor", F.when(F.col("focal") == 5, F.pmod(F.col("neighbor") + 1, F.lit(n))).otherwise(F.col("neighbor")))
        named = lambda c: F.pmod(F.col(c) * rename + 17, F.lit(n)).alias(c)  # noqa: E731  a renaming, as 3 and 7 have no factor in common with n
        return Graph(links.select(named("focal"), named("neighbor"), F.lit(1.0).alias("weight")).distinct(), spark.range(n))

    assert made(3, False).isomorphic(made(7, False), most=0)
    assert not made(3, False).isomorphic(made(7, True), most=0)
