"""Best-first trees against a plain version, ensembles cut short, gains, and fits that run side by side."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.plans.boosting import BoosterParams, VECTOR, assembler, first_rounds, fit_booster, importances, level_booster, predicted
from riskloom.plans.leafwise import UNITS, bin_edges, grow_tree, histograms, best_splits, with_bins
from riskloom.plans.training import greedy_search, side_by_side

PARAMS = BoosterParams(max_iter=4, max_depth=5, num_leaves=6, min_instances=4, step_size=0.3, subsampling=1.0, feature_share=1.0, max_bins=16)
NAMES = ["a", "b", "c"]


def table(spark, n=200, seed=1, target=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(12) / 4, rng.randrange(5), rng.random()
        y = (1.0 if a > 1.4 and b != 2 else 0.0) + (0.5 if c < 0.3 else 0.0) if target is None else target(a, b, c)
        rows.append((i, a, float(b), round(c, 1), y))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double").repartition(3)
    return assembler(NAMES).transform(df), rows


def plain_tree(x, g, edges, leaves, depth, least):
    """Best-first growth by trying every split of every leaf: nodes as (rows, depth), splits as they are taken."""

    def best(rows):
        found = None
        for f, own in enumerate(edges):
            for cut, e in enumerate(own):
                left, right = [r for r in rows if x[r][f] <= e], [r for r in rows if x[r][f] > e]
                if len(left) < least or len(right) < least:
                    continue
                gl, gr = sum(g[r] for r in left), sum(g[r] for r in right)
                gain = gl * gl / (len(left) * UNITS) + gr * gr / (len(right) * UNITS) - (gl + gr) ** 2 / (len(rows) * UNITS)
                if gain > 0 and (found is None or gain > found[0] * (1 + 1e-12)):
                    found = (gain, f, cut, left, right)
        return found

    open_leaves = [(list(range(len(x))), 0)]
    taken = []
    while len(open_leaves) < leaves:
        options = [(best(rows), k) for k, (rows, d) in enumerate(open_leaves) if d < depth]
        options = [(b, k) for b, k in options if b]
        if not options:
            break
        chosen, k = max(options, key=lambda o: o[0][0])
        d = open_leaves.pop(k)[1]
        open_leaves += [(chosen[3], d + 1), (chosen[4], d + 1)]
        taken.append((chosen[1], chosen[2], round(chosen[0] / UNITS, 6)))
    return taken, [rows for rows, _ in open_leaves]


def plain_boosting(x, y, edges, p):
    f = np.full(len(y), np.mean(y))
    widest = max(y) - min(y)
    for _ in range(p.max_iter):
        g = [int(np.floor(v + 0.5)) if v >= 0 else -int(np.floor(-v + 0.5)) for v in (np.array(y) - f) * (UNITS / widest)]
        _, parts = plain_tree(x, g, edges, p.num_leaves, p.max_depth, p.min_instances)
        if len(parts) == 1:
            break
        for rows in parts:
            f[rows] += p.step_size * widest * sum(g[r] for r in rows) / (len(rows) * UNITS)
    return f


def splits(node):
    return [] if node.left is None else [(node.feature, node.cut, round(node.gain / UNITS, 6))] + splits(node.left) + splits(node.right)


@pytest.mark.parametrize("leaves, depth", [(1, 8), (2, 8), (6, 8), (40, 3)])
def test_a_tree_takes_the_best_leaf_first(spark, leaves, depth):
    df, rows = table(spark)
    edges = bin_edges(df, VECTOR, 16)
    g = [round((r[4] - 0.7) * UNITS) for r in rows]
    ready = with_bins(df, VECTOR, edges).select("*", F.round((F.col("y") - 0.7) * UNITS).cast("long").alias("_g"), F.lit(UNITS).cast("long").alias("_h"))
    root, jobs = grow_tree(ready, range(3), leaves=leaves, depth=depth, min_instances=4)
    want, parts = plain_tree([r[1:4] for r in rows], g, edges, leaves, depth, 4)
    assert sorted(splits(root)) == sorted(want) and len(want) == len(parts) - 1 <= leaves - 1
    assert jobs <= depth + 1


def test_boosting_equals_the_plain_version(spark):
    df, rows = table(spark)
    x, y = [r[1:4] for r in rows], [r[4] for r in rows]
    model = fit_booster(df, None, target="y", params=PARAMS)
    got = {r["i"]: r["predicted"] for r in predicted(model, df).select("i", "predicted").collect()}
    want = plain_boosting(x, y, bin_edges(df, VECTOR, 16), PARAMS)
    assert [got[i] for i in range(len(rows))] == pytest.approx(want.tolist(), abs=1e-9)


def test_trees_do_not_depend_on_partitions(spark):
    df, _ = table(spark)
    drawn = replace(PARAMS, feature_share=0.7)
    edges = bin_edges(df, VECTOR, 16)

    def values(rows):
        rows = with_bins(rows, VECTOR, edges)
        return sorted(map(tuple, predicted(fit_booster(rows, None, target="y", params=drawn, edges=edges), rows).select("i", "predicted").collect()))

    assert values(df) == values(df.repartition(7)) == values(df.coalesce(1))


def test_the_best_round_is_kept(spark):
    df, _ = table(spark)
    valid, _ = table(spark, 60, seed=9, target=lambda a, b, c: 0.4 + a / 10)
    model = fit_booster(df, valid, target="y", params=replace(PARAMS, max_iter=8))
    errors = model.evaluateEachIteration(valid, "squared")
    longer = fit_booster(df, None, target="y", params=replace(PARAMS, max_iter=8))
    every = longer.evaluateEachIteration(valid, "squared")
    best = min(range(len(every)), key=every.__getitem__)
    assert len(model.trees) == max(best, 1) + 1 and errors == pytest.approx(every[: len(errors)])


def test_a_classifier(spark, tmp_path):
    df, rows = table(spark, target=lambda a, b, c: float(a > 1.4 and b != 2))
    model = fit_booster(df, df, target="y", params=replace(PARAMS, max_iter=10), task="classification")
    got = predicted(model, df, task="classification").select("y", "predicted").collect()
    assert all(0 < r["predicted"] < 1 for r in got)
    assert min(r["predicted"] for r in got if r["y"] == 1) > max(r["predicted"] for r in got if r["y"] == 0)
    PipelineModel([model]).write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(df).select("i", "probability").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, model.transform(df).select("i", "probability").collect()))
    base = sum(r[4] for r in rows) / len(rows)
    one = fit_booster(df, None, target="y", params=replace(PARAMS, max_iter=1, num_leaves=2, step_size=1e-9), task="classification")
    assert predicted(one, df, task="classification").first()["predicted"] == pytest.approx(base, abs=1e-6)


def test_odd_feature_values(spark):
    df, _ = table(spark, 40)
    odd = df.withColumn("c", F.when(F.col("i") % 4 == 0, float("nan")).when(F.col("i") % 4 == 1, float("inf")).otherwise(1.0)).drop(VECTOR)
    rows = assembler(NAMES).setHandleInvalid("keep").transform(odd)
    made = predicted(fit_booster(rows, None, target="y", params=PARAMS), rows)
    assert made.where("predicted is null or isnan(predicted)").count() == 0
    flat = assembler(NAMES).transform(df.withColumns({n: F.lit(1.0) for n in NAMES}).drop(VECTOR))
    assert len(fit_booster(flat, None, target="y", params=PARAMS).trees) == 1
    assert bin_edges(df.limit(0), VECTOR, 8) == []


def test_splits_of_several_leaves_at_once(spark):
    df, rows = table(spark)
    edges = bin_edges(df, VECTOR, 16)
    ready = with_bins(df, VECTOR, edges).select("*", F.round(F.col("y") * UNITS).cast("long").alias("_g"), F.lit(UNITS).cast("long").alias("_h"))
    leaf = F.when(F.col("i") < 50, 1).when(F.col("i") < 120, 2)
    got = {r["leaf"]: r for r in best_splits(histograms(ready, leaf, [0, 1, 2]), 4).collect()}
    for number, own in ((1, rows[:50]), (2, rows[50:120])):
        want, _ = plain_tree([r[1:4] for r in own], [round(r[4] * UNITS) for r in own], edges, 2, 9, 4)
        best = got[number]["best"]
        assert [(best["feature"], best["bin"], round(best["gain"] / UNITS, 6))] == want and got[number]["total"][0] == len(own)
    assert set(got) == {1, 2}


# -- Spark ML's own booster


def test_a_cut_ensemble_is_a_shorter_fit(spark):
    df, _ = table(spark)
    params = replace(PARAMS, num_leaves=0, max_iter=5, subsampling=0.8)
    whole = level_booster("y", params).fit(df)
    short = level_booster("y", replace(params, max_iter=2)).fit(df)
    values = lambda m: sorted(map(tuple, m.transform(df).select("i", "prediction").collect()))
    assert values(first_rounds(whole, 2)) == values(short) and first_rounds(whole, 9) is whole
    binary = df.withColumn("y", (F.col("y") > 0.6).cast("double"))
    kind = level_booster("y", params, "classification")
    cut = first_rounds(kind.fit(binary), 2)
    assert [t.numNodes for t in cut.trees] == [t.numNodes for t in level_booster("y", replace(params, max_iter=2), "classification").fit(binary).trees]
    stopped = fit_booster(df, df.withColumn("y", F.lit(0.5)), target="y", params=params)
    assert 1 <= len(stopped.trees) <= 5


def test_gains_add_up_what_splits_save(spark):
    df, rows = table(spark)
    one = replace(PARAMS, max_iter=1, max_depth=2, num_leaves=0, max_bins=32, min_instances=1)
    model = level_booster("y", one).fit(df)
    for fitted in (model, fit_booster(df, None, target="y", params=replace(one, num_leaves=4))):
        tree = fitted.trees[-1]
        found = tree.transform(df).groupBy("prediction").agg(F.sum(F.pow(F.col("y"), 2)) - F.pow(F.sum("y"), 2) / F.count("y")).collect()
        y = np.array([r[4] for r in rows])
        saved = ((y - y.mean()) ** 2).sum() - sum(r[1] for r in found)
        gains = importances(fitted, NAMES)
        assert sum(gains.values()) == pytest.approx(saved, rel=1e-5) and set(gains) == set(NAMES)


# -- fits side by side


def test_calls_run_at_once_in_pools_of_their_own(spark):
    import threading

    meet, pools = threading.Barrier(3, timeout=60), []

    def call(n):
        meet.wait()
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return spark.range(n).count()

    assert side_by_side(spark, 3, "t")(call, [5, 6, 7]) == [5, 6, 7] and sorted(pools) == ["t-0", "t-1", "t-2"]
    assert side_by_side(spark, 1, "t")(str, [1, 2]) == ["1", "2"]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, 2, "t")(lambda n: 1 // n, [1, 0])


def test_a_search_side_by_side_settles_on_the_same(spark):
    gains = {(6, 31, 20): 0.5, (8, 31, 20): 0.6, (8, 63, 20): 0.6, (8, 127, 20): 0.8, (8, 127, 50): 0.8}
    tried = []

    def gain(p):
        tried.append(p)
        return gains.get((p.max_depth, p.num_leaves, p.min_instances), float("nan"))

    grid = {"max_depth": (6, 8, 12), "num_leaves": (31, 63, 127), "min_instances": (20, 50, 150)}
    start = BoosterParams(min_instances=20)
    best = greedy_search(start, grid, gain, side_by_side(spark, 3, "s"))
    assert (best.max_depth, best.num_leaves, best.min_instances) == (8, 127, 20) and len(tried) == len(set(tried)) == 7
    assert best == greedy_search(start, grid, gain)


def test_nothing_is_measured_that_follows_from_a_split(spark):
    df, rows = table(spark)
    edges = bin_edges(df, VECTOR, 16)
    ready = with_bins(df, VECTOR, edges).select("_bins", (F.col("y") * UNITS).cast("long").alias("_g"), F.lit(UNITS).cast("long").alias("_h"))
    root, jobs = grow_tree(ready, range(3), leaves=4, depth=2, min_instances=4)
    assert jobs == 2
    found = {}
    for bins, g in ((r["_bins"], r["_g"]) for r in ready.collect()):
        node = root
        while node.left is not None:
            node = node.left if bins[node.feature] <= node.cut else node.right
        n, own = found.get(node.number, (0, 0))
        found[node.number] = (n + 1, own + g)
        assert node.depth <= 2 and node.sums.curvature == node.sums.n * UNITS
    open_nodes, sums = [root], {}
    while open_nodes:
        node = open_nodes.pop()
        if node.left is None:
            sums[node.number] = (node.sums.n, node.sums.gradient)
        else:
            open_nodes += [node.left, node.right]
    assert found == sums and len(sums) > 2
