"""Queries whose results or scratch files once outgrew their limits on larger tables."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_findings_r03 import compared

from edgeloom.operators import builders
from edgeloom.operators.graph import Graph
from edgeloom.plans.queries import CATALOG


def copies(places, times):
    """Suppliers of which as many share each place."""
    gen = np.random.default_rng(1)
    x, y = gen.uniform(-999, 9999, places).round(2), gen.integers(0, 25, places)
    return pd.DataFrame({"s_suppkey": range(places * times), "s_acctbal": np.tile(x, times), "s_nationkey": pd.Series(np.tile(y, times), dtype="int32")})


@pytest.mark.parametrize("name", ["distance_matrix", "distance_matrix_city_block"])
def test_file_of_all_pairs_is_small(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, supplier=copies(150, 2))  # several blocks
    assert got == want and len(got) == 300 * 299
    copies(100, 20).to_parquet(tmp_path / "supplier.parquet")
    CATALOG[name][0](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < 0.5 * 2000 * 1999


def test_haversine_kernel_links_places_not_points(spark, tmp_path, monkeypatch):
    keys = [*range(700), *range(6120, 6420), *range(12240, 12540), 3001, 9121]  # places return after 6120 keys
    sizes, joined = [], builders.sphere_band_join
    monkeypatch.setattr(builders, "sphere_band_join", lambda a, b, *x: sizes.append(a.count()) or joined(a, b, *x))
    got, want = compared(spark, tmp_path, "kernel_haversine", customer=pd.DataFrame({"c_custkey": keys}))
    assert got == want and (6120, 0, 1.0) in got and any(a == b for a, b, _ in got)
    assert sizes == [701]


def test_crowded_places_are_expanded_by_chunks(spark):
    at = spark.range(7).select("id", F.when(F.col("id") < 5, 1.0).when(F.col("id") == 5, 2.0).otherwise(F.lit(None)).alias("lon"), F.lit(0.0).alias("lat"))
    g = builders.expand_places(at, ("lon", "lat"), lambda p: p.crossJoin(p.select(F.col("id").alias("neighbor"))).filter("id = neighbor").select(F.col("id").alias("focal"), "neighbor", F.lit(2.0).alias("weight")), chunk=2)
    assert sorted(map(tuple, g.edges.collect())) == sorted([(a, b, 2.0) for a in range(5) for b in range(5) if a != b] + [(5, 5, 0.0), (6, 6, 0.0)])


def test_isomorphism_of_many_components_that_look_alike(spark):
    """2,400 nodes in rings of 6, and of 3, that colours can't tell apart; ``most`` bounds a component."""

    def rings(sizes, step=1):
        pairs, n = [], 0
        for k in sizes:
            pairs += [((n + i) * step, (n + (i + d) % k) * step, 1.0) for i in range(k) for d in (1, k - 1)]
            n += k
        return Graph(spark.createDataFrame(pairs, "focal long, neighbor long, weight double"))

    many = rings([6] * 398 + [3] * 4)
    assert many.isomorphic(rings([3] * 4 + [6] * 398, -1), most=6)
    assert not many.isomorphic(rings([6] * 397 + [3] * 6), most=6)


def test_band_tells_links_in_common_without_its_own(spark, monkeypatch):
    at = spark.range(30).select("id", (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"))
    band, other = builders.distance_band(at, 2.0), Graph(spark.createDataFrame([(0, 0, 1.0), (0, 2, 1.0), (0, 3, 1.0)], "focal long, neighbor long, weight double"), at)
    want = [(0, 2, 1.0)]
    monkeypatch.setattr(type(band), "links", lambda g: pytest.fail("all links of the band"))
    assert band.intersects(other) and other.intersects(band)
    for both in (band.intersection(other), other & band):
        assert [tuple(r) for r in both.edges.filter("weight > 0").collect()] == want
