"""Training, calibration and evaluation; only what SQL can fit as well has SQL to compare with."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import isotonic, metrics
from riskloom.operators.assemble import feature_frame
from riskloom.operators.holdout import HoldoutConfig
from riskloom.plans.boosting import BoosterParams, fit_calibrator
from riskloom.plans.evaluation import EvalConfig, ablations, evaluate_model
from riskloom.plans.training import TrainConfig, TrainingRun, score_frame, train
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources.registry import load_latest, save_run
from workloads import derived
from workloads.evaluation import SCORED, _ece_sql, _rounded, scored_lines
from workloads.registry import query, table

TODAY = date(2001, 12, 31)
_BOOSTER = BoosterParams(max_iter=4, max_depth=3, min_instances=20, step_size=0.3, max_bins=32)
_TRAIN = TrainConfig(n_splits=2, booster=_BOOSTER, depth_grid=(3,), leaves_grid=(8,), min_instances_grid=(20,))
_EVAL = EvalConfig(booster=_BOOSTER, holdout=HoldoutConfig())


def _frame(spark: SparkSession, folder: str) -> DataFrame:
    frame = feature_frame(derived.master(spark, folder), history=derived.history(spark, folder))
    return cut_lineage(frame)


def _trained(frame: DataFrame) -> TrainingRun:
    return train(frame, _TRAIN, today=TODAY)


@query()
def residual_train(spark: SparkSession, folder: str) -> DataFrame:
    """Train on the derived frame, save the run, load it back and score every row."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    root = scratch_path(spark, "registry")
    save_run(spark, root, run.model, run.metadata)
    model, _ = load_latest(spark, root)
    scored = score_frame(frame, model)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("predicted").between(-1.5, 1.5)).alias("n_in_range"),
        F.lit(len(run.metadata["fold_metrics"])).alias("n_folds"),
        F.lit(len(run.metadata["feature_names"])).alias("n_features"),
    )


@query()
def holdout_report(spark: SparkSession, folder: str) -> DataFrame:
    """Model and baseline on the rolling holdout with window, coverage, lift and gate."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    return evaluate_model(frame, run.model, run.metadata, today=TODAY, config=_EVAL)


@query()
def ablation_table(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline only, full, without the baseline's columns, and the residual model."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    return ablations(frame, run.model, run.metadata, today=TODAY, config=_EVAL)


def _isotonic_sql(points: str) -> str:
    """CTEs that fit ``points`` (x, n, pos): the largest over starts of the smallest mean over ends from there."""
    return f"""pts AS ({points}),
    runs AS (SELECT a.x AS a, b.x AS b, sum(c.n) AS n, sum(c.pos) AS pos FROM pts a
      JOIN pts b ON b.x >= a.x JOIN pts c ON c.x BETWEEN a.x AND b.x GROUP BY a.x, b.x),
    lows AS (SELECT p.x, r.a, min(CAST(r.pos AS DOUBLE) / CAST(r.n AS DOUBLE)) AS v FROM pts p
      JOIN runs r ON r.a <= p.x AND r.b >= p.x GROUP BY p.x, r.a),
    iso AS (SELECT x, max(v) AS v FROM lows GROUP BY x)"""


_POINTS = "SELECT p AS x, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p"


def _error_sql(calibrated: str) -> str:
    return f"""raw AS ({_ece_sql("p")}), cal AS ({_ece_sql("c").replace("FROM scored", f"FROM ({calibrated})")})
    SELECT 'raw' AS model, ece FROM raw UNION ALL SELECT 'calibrated' AS model, ece FROM cal"""


@query(
    f"WITH {SCORED}, {_isotonic_sql(_POINTS)}, "
    + _error_sql("SELECT scored.y, iso.v AS c FROM scored JOIN iso ON iso.x = scored.p")
)
def calibrate_isotonic(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration error before and after an isotonic map."""
    return _rounded(_calibrated(spark, folder, "isotonic"))


_TOTALS = "SELECT CAST(floor(o_totalprice / 2000) AS DOUBLE) AS x, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pos FROM orders GROUP BY 1"


@query(
    f"""WITH {_isotonic_sql(_TOTALS)} SELECT min(pts.x) AS low, max(pts.x) AS high, CAST(sum(n) AS BIGINT) AS n,
      CAST(sum(pos) AS BIGINT) AS positives FROM iso JOIN pts USING (x) GROUP BY v"""
)
def isotonic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a fit of order status to price level, pooled in ranges of fifty that are joined at their borders."""
    rows = table(spark, folder, "orders").select(F.floor(F.col("o_totalprice") / 2000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return isotonic.isotonic_blocks(rows, score="x", label="y", points=50)


# Newton's method on the logistic loss with a unit ridge on the slope, over the sums per score and label.
_NEWTON = """RECURSIVE sums AS (SELECT p AS x, y, CAST(count(*) AS DOUBLE) AS w FROM scored GROUP BY p, y),
 step AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum(w * (m - y) * x) + a AS ga, sum(w * (m - y)) AS gb, sum(w * m * (1 - m) * x * x) + 1 AS haa,
      sum(w * m * (1 - m) * x) AS hab, sum(w * m * (1 - m)) AS hbb
    FROM (SELECT i, a, b, x, y, w, 1 / (1 + exp(-(a * x + b))) AS m FROM step, sums WHERE i < 25) GROUP BY i, a, b)),
 line AS (SELECT a, b FROM step WHERE i = 25)"""


@query(
    f"WITH {_NEWTON.replace('RECURSIVE', 'RECURSIVE ' + SCORED + ',', 1)}, "
    + _error_sql("SELECT scored.y, 1 / (1 + exp(-(line.a * p + line.b))) AS c FROM scored, line").replace(", 9)", ", 5)")
)
def calibrate_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration error before and after a logistic map."""
    return _calibrated(spark, folder, "sigmoid").select("model", F.round("ece", 5).alias("ece"))


def _calibrated(spark: SparkSession, folder: str, method: str) -> DataFrame:
    rows = scored_lines(spark, folder)
    fitted = fit_calibrator(rows, score="p", label="y", method=method)
    long = metrics.long_scores(
        fitted.transform(rows, "p"), {"raw": "p", "calibrated": "calibrated"}, label="y"
    )
    return metrics.calibration_error(long, label="y", score="score", groups=["model"])
