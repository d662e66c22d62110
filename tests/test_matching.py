"""Matching by lists and prices against the dense solver."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom.operators import matching


def points(spark, xy, first=0):
    return spark.createDataFrame([(first + k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id bigint, x double, y double")


def total(graph, a, b, first):
    rows = [(r["focal"], r["neighbor"] - first) for r in graph.links().filter("weight > 0").collect()]
    assert len({j for _, j in rows}) == len(rows)
    return len(rows), sum(float(np.hypot(*(a[i] - b[j]))) for i, j in rows)


def test_listed_equals_dense():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 12), rng.integers(12, 20)
        cost = np.round(rng.random((n, m)) * 4) if rng.random() < 0.3 else rng.random((n, m))
        of, price, short = matching.assign_listed([list(enumerate(row)) for row in cost.tolist()], m)
        assert not short and len(set(of.tolist())) == n
        best = cost[np.arange(n), matching.assign(cost)].sum()
        assert cost[np.arange(n), of].sum() == pytest.approx(best)
        assert price.sum() >= best - 1e-9  # prices of the rights are 0 or less


def test_lists_too_short_are_told():
    of, _, short = matching.assign_listed([[(0, 1.0)], [(0, 2.0)], [(1, 1.0)]], 3)
    assert short == {0, 1} and sorted(of.tolist()) == [-1, 0, 1]


@pytest.mark.parametrize(("n", "m", "k", "kind"), [(25, 120, 3, "uniform"), (40, 43, 1, "crowded"), (1, 1, 1, "uniform")])
def test_spatial_matches_are_the_best(spark, n, m, k, kind):
    rng = np.random.default_rng(n)
    a = rng.random((n, 2)) * (0.2 if kind == "crowded" else 1)  # all lefts in one corner compete for the same rights
    b = rng.random((m, 2))
    g = matching.spatial_matches(points(spark, a), points(spark, b, 1000), k)
    cost = np.repeat(np.linalg.norm(a[:, None] - b[None], axis=2), k, axis=0)
    best = cost[np.arange(n * k), matching.assign(cost)].sum()
    assert total(g, a, b, 1000) == (n * k, pytest.approx(best))


def test_refusals(spark):
    with pytest.raises(ValueError, match="fewer"):
        matching.spatial_matches(points(spark, [(0, 0), (1, 1)]), points(spark, [(0, 0)], 10))
    assert matching.spatial_matches(points(spark, []), points(spark, [(0, 0)], 10)).links().filter("weight > 0").count() == 0
