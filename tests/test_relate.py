"""Nine-intersection matrices against cases made by hand, and their transposes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import relate

PARTS = "array<array<struct<x:double,y:double>>>"


def rect(l, b, r, t):
    return [(float(l), float(b)), (float(r), float(b)), (float(r), float(t)), (float(l), float(t))]


BIG = [rect(0, 0, 4, 4)]
RING = [rect(0, 0, 4, 4), rect(1, 1, 3, 3)[::-1]]
SLANTED = [[(0.0, 0.0), (3.0, 1.0), (2.0, 4.0)]]
CASES = {
    "apart": (BIG, [rect(6, 6, 7, 7)], "FF2FF1212"),
    "side by side": (BIG, [rect(4, 0, 8, 4)], "FF2F11212"),
    "part of a side": (BIG, [rect(4, 1, 8, 2)], "FF2F11212"),
    "corner": (BIG, [rect(4, 4, 8, 8)], "FF2F01212"),
    "corner on a side": (BIG, [[(4.0, 2.0), (6.0, 1.0), (6.0, 3.0)]], "FF2F01212"),
    "overlap": (BIG, [rect(2, 2, 6, 6)], "212101212"),
    "overlap along a side": (BIG, [rect(2, 0, 6, 4)], "212111212"),
    "equal": (BIG, [rect(0, 0, 4, 4)[::-1]], "2FFF1FFF2"),
    "equal with more corners": (BIG, [[(0.0, 0.0), (2.0, 0.0), *rect(0, 0, 4, 4)[1:]]], "2FFF1FFF2"),
    "holds": (BIG, [rect(1, 1, 2, 2)], "212FF1FF2"),
    "holds at a side": (BIG, [rect(1, 0, 2, 2)], "212F11FF2"),
    "within": ([rect(1, 1, 2, 2)], BIG, "2FF1FF212"),
    "in a hole": (RING, [rect(1.5, 1.5, 2, 2)], "FF2FF1212"),
    "fills a hole": (RING, [rect(1, 1, 3, 3)], "FF2F112F2"),
    "over a hole": (RING, BIG, "2FF11F2F2"),
    "cross": ([rect(0, 1, 6, 2)], [rect(2, -2, 3, 5)], "212101212"),
    "slanted, turned": (SLANTED, [SLANTED[0][1:] + SLANTED[0][:1]], "2FFF1FFF2"),
    "slanted, shared side": (SLANTED, [[(3.0, 1.0), (0.0, 0.0), (2.0, -3.0)]], "FF2F11212"),
    "two parts": ([rect(0, 0, 1, 1), rect(3, 3, 4, 4)], [rect(1, 0, 3.5, 3.5)], "212111212"),
}


def test_matrices(spark):
    rows = [(name, a, b, want) for name, (a, b, want) in CASES.items()]
    df = spark.createDataFrame(rows, f"name string, a {PARTS}, b {PARTS}, want string")
    got = df.select("name", "want", relate.relate(F.col("a"), F.col("b")).alias("m"), relate.relate(F.col("b"), F.col("a")).alias("t")).collect()
    turned = lambda m: "".join(m[3 * j + i] for i in range(3) for j in range(3))
    assert {r["name"]: (r["m"], r["t"]) for r in got} == {r["name"]: (r["want"], turned(r["want"])) for r in got}
    plan = df.select(relate.relate(F.col("a"), F.col("b")))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize(
    ("relation", "true"),
    [
        ("equals", {"equal", "equal with more corners", "slanted, turned"}),
        ("disjoint", {"apart", "in a hole"}),
        ("touches", {"side by side", "part of a side", "corner", "corner on a side", "fills a hole", "slanted, shared side"}),
        ("contains", {"equal", "equal with more corners", "slanted, turned", "holds", "holds at a side"}),
        ("within", {"equal", "equal with more corners", "slanted, turned", "within", "over a hole"}),
        ("overlaps", {"overlap", "overlap along a side", "cross", "two parts"}),
    ],
)
def test_relations(spark, relation, true):
    df = spark.createDataFrame([(name, want) for name, (_, _, want) in CASES.items()], "name string, m string")
    assert {r["name"] for r in df.filter(relate.holds(F.col("m"), relation)).collect()} == true


def test_points_nulls_and_patterns(spark):
    df = spark.createDataFrame([(2.0, 2.0), (0.5, 0.5), (0.0, 2.0), (9.0, 9.0)], "x double, y double")
    ring = F.lit(None).cast(PARTS)
    held = spark.createDataFrame([(RING,)], f"b {PARTS}")
    got = [r[0] for r in df.crossJoin(held).orderBy("x", "y").select(relate.relate_point(F.struct("x", "y"), F.col("b"))).collect()]
    assert got == ["F0FFFF212", "0FFFFF212", "FF0FFF212", "FF0FFF212"]
    assert held.select(relate.relate(F.col("b"), ring)).first()[0] is None
    assert held.select(relate.fits(F.lit("212101212"), "T*T***T**"), relate.fits(F.lit("212101212"), "2121F1212")).first() == (True, False)
    with pytest.raises(ValueError):
        relate.fits(F.lit("x"), "T**")
