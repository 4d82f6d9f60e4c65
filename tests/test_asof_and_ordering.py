from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators.asof import asof_join, asof_lookup
from riskloom.operators.dedup import keep_first, keep_last
from riskloom.operators.ordering import number_all, number_in_groups, running_totals, slice_edges

DAY0 = date(2024, 1, 1)


def skewed(n, keys, days, seed):
    """Rows of which a third carry one key, many on the same day."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        key = "hot" if hot else f"k{rng.randrange(keys)}"
        day = DAY0 + timedelta(days=0 if hot and rng.random() < 0.3 else rng.randrange(days))
        rows.append((i, key, day, rng.randrange(100)))
    return rows


def best_as_of(left, right):
    by_key = {}
    for i, k, d, v in right:
        by_key.setdefault(k, []).append((d, i, v))
    out = {}
    for i, k, d, _ in left:
        seen = [m for m in by_key.get(k, []) if m[0] <= d]
        out[i] = max(seen)[2] if seen else None
    return out


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_asof_join_is_exact_for_any_slicing(spark, slices):
    left, right = skewed(400, 12, 40, 1), skewed(300, 12, 40, 2)
    schema = "i int, k string, d date, v int"
    found = asof_join(
        spark.createDataFrame(left, schema),
        spark.createDataFrame(right, schema),
        on=["k"],
        left_time="d",
        right_time="d",
        values={"seen": "v"},
        tie_break=["i"],
        slices=slices,
    )
    assert {r["i"]: r["seen"] for r in found.collect()} == best_as_of(left, right)


def test_asof_join_keeps_unmatched_and_null_rows(spark):
    left = spark.createDataFrame(
        [(1, "a", datetime(2024, 1, 2, 10)), (2, "a", None), (3, None, datetime(2024, 1, 2)), (4, "b", datetime(2023, 1, 1))],
        "i int, k string, t timestamp",
    )
    right = spark.createDataFrame(
        [("a", datetime(2024, 1, 2, 10), 5), ("a", None, 7), (None, datetime(2020, 1, 1), 8), ("b", datetime(2024, 1, 1), 9)],
        "k string, t timestamp, v int",
    )
    found = asof_join(
        left, right, on=["k"], left_time="t", right_time="t", values={"seen": "v"}, fill={"seen": 0}, matched="at"
    )
    got = {r["i"]: (r["seen"], r["at"]) for r in found.collect()}
    assert got == {1: (5, datetime(2024, 1, 2, 10)), 2: (0, None), 3: (0, None), 4: (0, None)}


def test_asof_lookup_takes_the_latest_known(spark):
    left = spark.createDataFrame([("a", DAY0), ("b", DAY0)], "k string, d date")
    right = spark.createDataFrame(
        [("a", DAY0, 1), ("a", DAY0, 3), ("a", DAY0 - timedelta(1), 9), ("b", DAY0 + timedelta(1), 4)],
        "k string, d date, v int",
    )
    found = asof_lookup(left, right, on="k", left_time="d", right_time="d", values={"seen": "v"}, fill={"seen": 0})
    assert {r["k"]: r["seen"] for r in found.collect()} == {"a": 3, "b": 0}


@pytest.mark.parametrize("moments", [False, True])
def test_asof_lookup_of_many_times_joins_no_pairs(spark, moments):
    rng = random.Random(12)
    day = lambda n: DAY0 + timedelta(n)
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(20)])) for i in range(200)]
    known = [(rng.choice(["a", "b", None]), rng.choice([None, *range(25)]), rng.choice([None, *range(9)])) for _ in range(90)]
    at = lambda n: None if n is None else datetime(2000, 1, 1, 9) + (day(n) - datetime(2000, 1, 1).date()) if moments else day(n)
    left = spark.createDataFrame([(i, k, at(n)) for i, k, n in asked], f"i int, k string, d {'timestamp' if moments else 'date'}")
    right = spark.createDataFrame([(k, None if n is None else day(n), v) for k, n, v in known], "k string, d date, v int")
    found = asof_lookup(left, right, on="k", left_time="d", right_time="d", values={"seen": "v"}, matched="at")
    want = {}
    for i, k, n in asked:
        best = max(((m, -1 if v is None else v) for o, m, v in known if k and n is not None and o == k and m is not None and m <= n), default=None)
        want[i] = (None, None) if best is None else (None if best[1] < 0 else best[1], day(best[0]))
    assert {r["i"]: (r["seen"], r["at"]) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("slices", [1, 3, 50])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, slices, descending):
    rng = random.Random(3)
    points = {(g, rng.random()) for g in "ab" for _ in range(120)} | {("a", 0.0), ("b", 1.0)}
    rows = [(g, x, rng.randrange(5)) for g, x in points]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    edges = slice_edges(df, "x", slices)
    got = running_totals(df, by="x", values=["n"], groups=["g"], edges=edges, descending=descending)

    def want(g, x):
        return sum(n for h, y, n in rows if h == g and (y >= x if descending else y <= x))

    assert all(r["cum_n"] == want(r["g"], r["x"]) for r in got.collect())
    assert got.count() == len(rows)


def test_null_groups_stay_whole(spark):
    df = spark.createDataFrame([(None, 0.1, 1), (None, 0.2, 2), ("a", 0.3, 4)], "g string, x double, n int")
    got = running_totals(df, by="x", values=["n"], groups=["g"], edges=[0.15])
    assert {(r["g"], r["x"]): r["cum_n"] for r in got.collect()} == {(None, 0.2): 2, (None, 0.1): 3, ("a", 0.3): 4}
    numbered = number_in_groups(df, [F.col("x").asc()], groups=["g"], slice_of=F.floor(F.col("x") * 10))
    assert sorted((str(r["g"]), r["position"]) for r in numbered.collect()) == [("None", 1), ("None", 2), ("a", 1)]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_numbers_in_groups_do_not_depend_on_slices(spark, width):
    rows = skewed(500, 9, 5, 4)
    df = spark.createDataFrame(rows, "i int, k string, d date, v int").repartition(6)
    order = [F.col("v").desc(), F.col("i").asc()]
    got = number_in_groups(df, order, groups=["k"], slice_of=-F.floor(F.col("v") / width))
    want = {}
    for key in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[3], r[0]))
        want |= {r[0]: n for n, r in enumerate(ordered, 1)}
    assert {r["i"]: r["position"] for r in got.collect()} == want


def test_numbers_over_everything(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("x"))
    got = number_all(df, [F.col("x").asc()])
    assert all(r["position"] == r["x"] + 1 for r in got.collect())


def test_keep_first_and_last(spark):
    rows = skewed(200, 5, 10, 5)
    df = spark.createDataFrame(rows, "i int, k string, d date, v int").repartition(5)
    first = {r["k"]: r["i"] for r in keep_first(df, ["k"], ["d", "i"]).collect()}
    last = {r["k"]: r["i"] for r in keep_last(df, ["k"], ["d", "i"]).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == key)
        assert (first[key], last[key]) == (mine[0][1], mine[-1][1])


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(10, 2, 2, 6), "i int, k string, d date, v int")
    plan = keep_first(df, ["k"], ["d", "i"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
