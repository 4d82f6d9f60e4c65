"""The isotonic fit joined range by range against one pass and against the definition."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from riskloom.operators.isotonic import isotonic_blocks, isotonic_value, pool
from riskloom.plans.boosting import fit_calibrator


def sums(points):
    out = {}
    for p, y in points:
        n, s = out.get(p, (0, 0))
        out[p] = (n + 1, s + y)
    return sorted((p, p, n, s) for p, (n, s) in out.items())


def by_definition(points):
    """Value at each score: the largest over starts of the smallest mean over ends."""
    rows = sums(points)

    def mean(a, b):
        return Fraction(sum(r[3] for r in rows[a : b + 1]), sum(r[2] for r in rows[a : b + 1]))

    k = len(rows)
    return {rows[i][0]: max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)}


def made(kind, seed):
    rng = random.Random(seed)
    if kind == "falling":
        return [(float(i), int(rng.random() < 1 - i / 60)) for i in range(60)]
    if kind == "rising":
        return [(float(i), int(j < i)) for i in range(12) for j in range(12)]
    if kind == "cascade":  # a long rise and a heavy low end: the last point takes back block after block
        return [(float(i), int(j < i)) for i in range(30) for j in range(30)] + [(99.0, 0)] * 3000
    if kind == "saw":
        return [(float(i), int(j < i % 7)) for i in range(56) for j in range(7)]
    return [(rng.randrange(40) / 8, rng.randrange(2)) for _ in range(300)]


@pytest.mark.parametrize("kind, points", [("falling", 10), ("rising", 3), ("cascade", 6), ("saw", 10), ("random", 10), ("random", 10**6)])
def test_blocks_do_not_depend_on_ranges(spark, kind, points):
    data = made(kind, 4)
    df = spark.createDataFrame(data, "p double, y int").repartition(3)
    got = [tuple(r) for r in isotonic_blocks(df, score="p", label="y", points=points).sort("low").collect()]
    assert got == [tuple(b) for b in pool(sums(data))]
    values = {p: next(Fraction(s, n) for low, high, n, s in got if low <= p <= high) for p, _ in data}
    assert values == by_definition(data)


def test_values_between_and_outside_blocks(spark):
    points = [(1.0, 0), (2.0, 0), (4.0, 1), (4.0, 0), (6.0, 1)]
    blocks = isotonic_blocks(spark.createDataFrame(points, "p double, y int"), score="p", label="y")
    asked = [float("-inf"), 0.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, float("inf"), float("nan"), None, 3.0]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, p double")
    got = dict(map(tuple, isotonic_value(df, blocks, score="p", out="v").select("i", "v").collect()))
    assert [got[i] for i in range(len(asked))] == [0.0, 0.0, 0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 1.0, None, None, 0.25]


def test_rows_that_do_not_count(spark):
    rows = [(0.0, 0), (-0.0, 1), (None, 1), (float("nan"), 0), (0.5, None)]
    blocks = isotonic_blocks(spark.createDataFrame(rows, "p double, y int"), score="p", label="y")
    assert [tuple(r) for r in blocks.collect()] == [(0.0, 0.0, 2, 1)]
    none = spark.createDataFrame([], "p double, y int")
    empty = isotonic_blocks(none, score="p", label="y")
    assert empty.collect() == []
    asked = spark.createDataFrame([(0.3,)], "p double")
    assert isotonic_value(asked, empty, score="p", out="v").collect()[0]["v"] is None
    assert fit_calibrator(none, score="p", label="y").transform(asked, "p").collect()[0]["calibrated"] == 0.3


def test_calibrated_column_replaces_one_of_its_name(spark):
    df = spark.createDataFrame([(0.1, 0, "a"), (0.9, 1, "b")], "p double, y int, calibrated string")
    out = fit_calibrator(df, score="p", label="y").transform(df, "p")
    assert out.columns == ["p", "y", "calibrated"] and sorted(r["calibrated"] for r in out.collect()) == [0.0, 1.0]
