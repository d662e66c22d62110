"""Queries against their SQL on small tables that once gave other results."""

import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import regions
from edgeloom.operators import builders
from edgeloom.operators.graph import Graph
from edgeloom.plans import queries as plans
from edgeloom.plans.queries import CATALOG
from edgeloom.sources import matrices, weights_text

plans.queries()


def compared(spark, folder, name, **tables):
    """Rows of a query over these tables, and of its SQL, in order."""
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(os.path.join(folder, f"{table}.parquet"))
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    plan, sql = CATALOG[name]
    got = plan(spark, str(folder))
    key = lambda r: tuple((x is None, x) for x in r)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({sql})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)


def parts(keys):
    return pd.DataFrame({"p_partkey": pd.Series(keys, dtype="int64"), "p_size": pd.Series(30, index=range(len(keys)), dtype="int32"), "p_retailprice": [900.0 + k % 7 for k in keys]})


def test_raster_cells_of_the_first_part_and_of_keys_beyond_an_int(spark, tmp_path):
    got, want = compared(spark, tmp_path, "raster_cells", part=parts([0, 1, 2, 41, 42, 200_000_000_001]))
    assert got == want and len(got) == 6


def test_raster_lag_grid_with_the_first_part(spark, tmp_path):
    got, want = compared(spark, tmp_path, "raster_lag_grid", part=parts([0, 1, 2, 3, 40, 41, 42, 83]))
    assert got == want and len(got) == 3 * 41


def test_raster_lag_grid_of_negative_keys_and_of_parts_at_one_place(spark, tmp_path):
    for k, keys in enumerate((list(range(-100, 0)), [1, 2, 2, 3, 41, 42, 42, 42, 83, 200])):
        os.mkdir(tmp_path / str(k))
        got, want = compared(spark, tmp_path / str(k), "raster_lag_grid", part=parts(keys))
        assert got == want and len(got) == (3 * 40, 5 * 40)[k]


def test_raster_lag_grid_of_a_place_alone_with_an_infinite_value(spark, tmp_path):
    rows = parts([1, 2, 100])
    rows["p_retailprice"] = [1.0, 2.0000005, float("inf")]
    got, want = compared(spark, tmp_path, "raster_lag_grid", part=rows)
    assert got == want and (2, 19, 0.0) in got


def test_knn_haversine_of_customers_within_metres_and_less(spark, tmp_path):
    """No distance ties here, so the SQL's rows are fixed: pairs of about 5 metres, where the second decimal turns, and points
    apart by the last digits of their balances."""
    gen = np.random.default_rng(3)
    at = 50 + np.arange(40) * 1e-5
    lat, lon = (at * 104729 % 170 - 85), 7919 / 104729
    step = np.degrees(0.005 / 6371) / np.sqrt(1 + (lon * np.cos(np.radians(lat))) ** 2) / 104729
    pairs = np.concatenate([at, at + step * (1 + gen.uniform(-1e-4, 1e-4, 40))])
    for k, balances in enumerate((pairs, 1.0 + np.cumsum(np.random.default_rng(8).integers(1, 9, 60)) * 2.0**-52)):
        os.mkdir(tmp_path / str(k))
        got, want = compared(spark, tmp_path / str(k), "knn_haversine", customer=pd.DataFrame({"c_custkey": range(len(balances)), "c_acctbal": balances}))
        assert got == want and len(got) == 2 * len(balances)


def suppliers(balances):
    return pd.DataFrame({"s_suppkey": range(len(balances)), "s_acctbal": [float(b) for b in balances], "s_nationkey": pd.Series(0, index=range(len(balances)), dtype="int32")})


def test_default_bandwidth_keeps_the_pairs_beyond_it(spark, tmp_path):
    got, want = compared(spark, tmp_path, "kernel_default_bandwidth", supplier=suppliers([0, 1, 3, 10, 100]))
    assert got == want and len(got) == 20 and sum(w == 0 for _, _, w in got) == 14
    assert compared(spark, tmp_path, "kernel_default_bandwidth", supplier=suppliers([7]))[0] == [(0, 0, 0.0)]


@pytest.mark.parametrize("name", ["distance_matrix", "distance_matrix_city_block"])
def test_all_pairs_are_dealt_out_to_tasks(spark, tmp_path, name):
    suppliers(range(10_000)).to_parquet(tmp_path / "supplier.parquet")  # one file, one split
    assert CATALOG[name][0](spark, str(tmp_path)).rdd.getNumPartitions() == 5
    got, want = compared(spark, tmp_path, name, supplier=suppliers([0, 1.0000005, 3, 1e12]))
    assert got == want and len(got) == 12


def ring(spark, n):
    return Graph(spark.range(1, n + 1).select(F.col("id").alias("focal"), (F.col("id") % n + 1).alias("neighbor"), (F.col("id") % 5 + 0.5).alias("weight")))


def test_matlab_file_of_many_nodes_isn_t_their_square(spark, tmp_path):
    g = ring(spark, 2500)
    matrices.write_mat(g, f"{tmp_path}/w.mat")
    assert os.path.getsize(f"{tmp_path}/w.mat") < 100_000
    assert sorted(map(tuple, matrices.read_mat(spark, f"{tmp_path}/w.mat").edges.collect())) == sorted((a - 1, b - 1, w) for a, b, w in g.edges.collect())


def test_full_matlab_matrix_comes_in_pieces():
    i, j, w = np.array([0, 3, 2, 3]), np.array([3, 0, 1, 3]), np.array([1.0, 2.0, 3.0, 4.0])
    parts = list(matrices.matlab_parts(4, i, j, w, False, block=8))
    assert len(parts) == 3
    n, *cells = matrices.matlab_cells(b"".join(parts))
    assert n == 4 and sorted(zip(*(x.tolist() for x in cells), strict=True)) == sorted(zip(i.tolist(), j.tolist(), w.tolist(), strict=True))


def test_geobugs_text_is_read_in_time_linear_in_its_length(spark, tmp_path):
    n = 20_000
    num, adj = [0 if k % 1000 == 0 else 4 for k in range(n)], []
    for k, m in enumerate(num):
        adj += [(k + j) % n + 1 for j in range(1, m + 1)]
    text = ", ".join
    with open(f"{tmp_path}/w.txt", "w") as f:
        f.write(f"list(\nnum=c({text(map(str, num))}),\nadj=c({text(map(str, adj))}),\nweights=c({text('0.5' for _ in adj)}),\nsumNumNeigh={len(adj)})\n")
    start = time.time()
    got = weights_text.read_geobugs(spark, f"{tmp_path}/w.txt").edges.agg(F.count(F.lit(1)), F.sum("weight"), F.count_if(F.col("focal") == F.col("neighbor")), F.sum(F.col("focal") * 7 + F.col("neighbor"))).first()
    focal = [k + 1 for k, m in enumerate(num) for _ in range(m)]
    lone = [k + 1 for k, m in enumerate(num) if not m]
    assert tuple(got) == (len(adj) + 20, len(adj) / 2, 20, 7 * sum(focal) + sum(adj) + 8 * sum(lone))
    assert time.time() - start < 60


def test_convex_buffer_is_the_union_of_the_sides_buffers(monkeypatch):
    rng = np.random.default_rng(5)
    rings = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (4, 0), (0, 3)], [(2, 1), (0, 0), (0, 1), (0, 2)]]
    for n in (5, 9):
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        rings.append(np.stack([3 * np.cos(a), 2 * np.sin(a)], 1).tolist())
    assert regions._convex_buffered(np.array([(0, 0), (2, 0), (2, 2), (1, 0.5)], float), 0.5, 16) is None
    quick = [regions._convex_buffered(np.array(r, float), 0.5, 16) for r in rings]
    monkeypatch.setattr(regions, "_convex_buffered", lambda *a: None)
    for ring, got in zip(rings, quick, strict=True):
        want = regions.buffered([np.array(ring, float)], 0.5)
        assert regions.area(got) == pytest.approx(sum(regions.area(r) for r in want), rel=1e-9)
        assert sum(abs(regions.area(r)) for r in regions.overlay([got], want, "symmetric_difference")) < 1e-8


def test_cliques_of_a_crowded_place_are_dealt_out_to_tasks(spark, tmp_path):
    n = 4000  # three in four parts at one place, one place with one part
    rows = pd.DataFrame({"p_partkey": range(n), "p_size": pd.Series([1 if k % 4 else 2 + k % 3 for k in range(n)], dtype="int32"), "p_retailprice": 900.0})
    rows.loc[n - 1, "p_size"] = 40
    rows["p_size"] = rows["p_size"].astype("int32")
    rows.to_parquet(tmp_path / "part.parquet")
    pairs = CATALOG["knn_coplanar_clique"][0](spark, str(tmp_path))
    by_task = [r[1] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 4 and max(by_task) < 0.6 * sum(by_task)
    few = rows.iloc[::40].assign(p_partkey=lambda t: range(len(t)))
    got, want = compared(spark, tmp_path, "knn_coplanar_clique", part=few)
    assert got == want


def test_cliques_leave_isolates(spark):
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id bigint, x double, y double")
    assert sorted(map(tuple, builders.knn(spots, 1, coplanar="clique").edges.collect())) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert [tuple(r) for r in builders.knn(spots.filter("id = 1"), 1, coplanar="clique").edges.collect()] == [(1, 1, 0.0)]


def test_graphs_of_unequal_size_differ_without_a_shuffle_of_their_edges(spark, monkeypatch):
    a, b = ring(spark, 5), ring(spark, 6)
    assert a == ring(spark, 5)
    assert a != Graph(a.edges.withColumn("weight", F.lit(9.0)))
    monkeypatch.setattr(type(a.edges), "exceptAll", lambda *x: pytest.fail("a shuffle of all edges"))
    assert a != b
