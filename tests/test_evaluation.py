from __future__ import annotations

import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators.folds import assign_folds, fold_sizing, plan_folds
from riskloom.operators.holdout import (
    HoldoutConfig,
    content_hash,
    find_holdout,
    holdout_rows,
    training_rows,
)


def daily(spark, start, n, every):
    rows = [(f"CVE-2024-{i:04d}", start + timedelta(days=i), i % every == 0) for i in range(n)]
    return spark.createDataFrame(rows, "cve_id string, published_date date, exploited_30d boolean")


def test_holdout_ends_on_the_latest_day(spark):
    found = find_holdout(daily(spark, date(2024, 1, 1), 200, 20))
    assert (found.end, found.window_days, found.n_rows) == (date(2024, 7, 18), 90, 90)


def test_sparse_holdout_reports_the_shortest_window(spark):
    found = find_holdout(daily(spark, date(2024, 1, 1), 10, 100))
    assert not found.found and "minimums" in found.reason
    assert "last 14d with n=10, positives=1" in found.reason


def test_holdout_of_nothing(spark):
    rows = daily(spark, date(2024, 1, 1), 5, 2).where(F.lit(False))
    found = find_holdout(rows)
    assert not found.found and found.n_rows == 0 and "no closed-window rows" in found.reason
    assert holdout_rows(rows, found).isEmpty()


def test_candidate_lengths():
    assert HoldoutConfig().candidate_days() == [90, 45, 22, 14]
    assert HoldoutConfig(holdout_days=10).candidate_days() == [10]
    assert HoldoutConfig(holdout_days=15).candidate_days() == [15, 14]


def test_training_rows_and_leak(spark):
    rows = daily(spark, date(2023, 6, 1), 400, 20)
    window = find_holdout(rows)
    kept = training_rows(rows, window)
    assert kept.n_rows == 310 and not kept.holdout_leak and kept.last_day < window.start
    assert training_rows(rows, window, embargo_days=30).n_rows == 280
    leaking = training_rows(rows, window, min_positives=1000)
    assert leaking.n_rows == 400 and leaking.holdout_leak


def test_content_hash_is_that_of_its_blocks(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    rows = daily(spark, date(2024, 1, 1), 30, 7)
    level = [(digest(r[0]), f"{r[0]},{r[1].isoformat()},{int(r[2])},1") for r in rows.collect()]
    for digits in (6, 3):
        blocks = {}
        for key, text in level:
            blocks.setdefault(key[:digits], []).append(text)
        level = [(key, f"{key},{digest(chr(10).join(sorted(texts)))}") for key, texts in blocks.items()]
    root = digest("\n".join(sorted(text for _, text in level)))
    want = digest(f"cve_id,published_date,exploited_30d\n,{root}")
    for parts in (1, 5):
        got = content_hash(rows.repartition(parts)).first()
        assert (got["sha256"], got["n_rows"]) == (want, rows.count())
    assert content_hash(rows.where("exploited_30d is null")).first()["n_rows"] == 0
    changed = rows.withColumn("exploited_30d", ~F.col("exploited_30d"))
    assert content_hash(changed).first()["sha256"] != want
    with pytest.raises(ValueError, match="exploited_30d"):
        content_hash(rows.drop("exploited_30d"))


def test_folds_are_disjoint_and_embargoed(spark):
    first, last = date(2022, 1, 1), date(2022, 12, 31)
    folds = plan_folds(first, last, n_splits=3, horizon_days=30, embargo_days=30)
    assert all((f.valid_from - f.train_until).days == 31 for f in folds)
    rows = spark.createDataFrame([(first + timedelta(days=i),) for i in range(365)], "d date")
    got = {}
    for r in assign_folds(rows, folds, day="d").collect():
        got.setdefault((r["fold"], r["role"]), set()).add(r["d"])
    valid = [got[(i, "valid")] for i in range(3)]
    assert all(len(v) == 30 for v in valid) and not (valid[0] & valid[1]) and not (valid[1] & valid[2])
    assert got[(0, "train")] < got[(1, "train")] < got[(2, "train")]
    assert max(valid[2]) == last


@pytest.mark.parametrize(
    "arguments", [(0, 30, 30), (3, 0, 30), (3, 30, -1), (5, 30, 30)], ids=["splits", "horizon", "embargo", "span"]
)
def test_fold_arguments(arguments):
    n, horizon, embargo = arguments
    with pytest.raises(ValueError):
        plan_folds(date(2022, 1, 1), date(2022, 1, 30), n_splits=n, horizon_days=horizon, embargo_days=embargo)


def test_fold_of_nothing():
    with pytest.raises(ValueError, match="without dates"):
        plan_folds(None, None, n_splits=1, horizon_days=1, embargo_days=0)


def test_fold_sizing():
    assert fold_sizing(219, 2, 30) == (2, 73)
    assert fold_sizing(1000, 5, 30) == (5, 166)
    assert fold_sizing(100, 5, 30) == (2, 30)


def average_precision(y, p):
    total, points = y.sum(), 0.0
    for t in np.unique(p)[::-1]:
        hit = p >= t
        points += y[p == t].sum() / total * (y[hit].sum() / hit.sum())
    return points


def roc_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def ece(y, p, bins=10):
    p = np.clip(p, 0, 1)
    edges = np.linspace(0, 1, bins + 1)
    gap = 0.0
    for i in range(bins):
        mask = (p >= edges[i]) & ((p <= edges[i + 1]) if i == bins - 1 else (p < edges[i + 1]))
        if mask.any():
            gap += abs(p[mask].mean() - y[mask].mean()) * mask.sum() / len(y)
    return gap


@pytest.mark.parametrize("kind", ["uniform", "ties", "edges", "outside"])
@pytest.mark.parametrize("slices", [1, 16])
def test_metrics_match_their_definitions(spark, kind, slices):
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 1000)
    p = {
        "uniform": rng.random(1000),
        "ties": rng.integers(0, 4, 1000) / 4,
        "edges": rng.integers(0, 11, 1000) * 0.1,
        "outside": rng.normal(0.5, 0.6, 1000),
    }[kind]
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "i int, y int, p double")
    row = metrics.evaluate(df, label="y", score="p", slices=slices).first()
    clipped = np.clip(p, 0, 1)
    assert row["auc_pr"] == pytest.approx(average_precision(y, p), abs=1e-12)
    assert row["auc_roc"] == pytest.approx(roc_auc(y, p), abs=1e-12)
    assert row["brier"] == pytest.approx(((clipped - y) ** 2).mean(), abs=1e-12)
    assert row["ece"] == pytest.approx(ece(y, p), abs=1e-12)
    assert metrics.calibration_error(df, label="y", score="p").first()[0] == pytest.approx(ece(y, p), abs=1e-12)
    assert metrics.brier(df, label="y", score="p").first()[0] == pytest.approx(row["brier"], abs=1e-12)
    order = sorted(range(1000), key=lambda i: (-p[i], i))
    for k in (1, 10, 500, 5000):
        top = metrics.precision_at_k(df, label="y", score="p", k=k, tie_break=["i"]).first()[0]
        assert top == pytest.approx(y[order[:k]].mean(), abs=1e-12)


def test_metrics_without_two_classes_or_rows(spark):
    df = spark.createDataFrame([(1, 0.2, "a"), (1, 0.4, "a"), (0, 0.1, "b"), (1, 0.3, "b")], "y int, p double, g string")
    got = {r["g"]: r for r in metrics.evaluate(df, label="y", score="p", groups=["g"]).collect()}
    assert math.isnan(got["a"]["auc_pr"]) and math.isnan(got["a"]["auc_roc"]) and got["b"]["auc_roc"] == 1.0
    empty = df.where("y > 5")
    row = metrics.evaluate(empty, label="y", score="p").first()
    assert row["n"] == 0 and all(math.isnan(row[m]) for m in ("auc_pr", "auc_roc", "brier", "ece"))
    assert math.isnan(metrics.precision_at_k(df, label="y", score="p", k=0, tie_break=[]).first()[0])
    assert math.isnan(metrics.precision_at_k(empty, label="y", score="p", k=5, tie_break=[]).first()[0])


def test_gate(spark):
    df = spark.createDataFrame(
        [(i, int(i % 3 == 0), (i % 3 == 0) * 0.5 + i / 1000, i / 100) for i in range(60)],
        "i int, y int, good double, bad double",
    )

    def passed(model, margin):
        made = metrics.compare_models(
            df, {"m": model, "base": "good"}, label="y", baseline="base", k=10, tie_break=["i"], margin=margin
        )
        return {r["model"]: r["gate_passed"] for r in made.collect()}["m"]

    assert passed("bad", 1.0) and not passed("bad", 0.1) and passed("good", 0.0)
    one = df.withColumn("y", F.lit(1))
    made = metrics.compare_models(one, {"m": "bad", "base": "good"}, label="y", baseline="base", k=1, tie_break=["i"])
    assert not any(r["gate_passed"] for r in made.collect())
