"""Residual training: embargoed folds, greedy tuning, final model and run facts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.assemble import feature_names
from riskloom.operators.folds import Fold, assign_folds, fold_rows, fold_sizing, fold_summary, plan_folds
from riskloom.operators.holdout import HoldoutConfig, content_hash, find_holdout, holdout_rows, training_rows
from riskloom.operators.labels import drop_open_rows
from riskloom.operators.metrics import evaluate, metric_bundle
from riskloom.operators.score import blend
from riskloom.plans.boosting import (
    VECTOR,
    BoosterParams,
    as_pipeline,
    assembler,
    fit_booster,
    importances,
    predicted,
)
from riskloom.plans.leafwise import bin_edges, with_bins
from riskloom.session import cut_lineage, kept

MODEL_VERSION = "gbt@v0.1.0"
STRATEGY = "epss_complement"
BASELINE = "f_epss_score"
LABEL = "exploited_30d"
DAY = "published_date"
METRICS = ("auc_pr", "auc_roc", "precision_at_k", "brier")


@dataclass(frozen=True)
class TrainConfig:
    """Everything a run depends on besides its rows."""

    n_splits: int = 5
    embargo_days: int = 30
    holdout_embargo_days: int = 0
    min_rows: int = 100
    min_positives: int = 5
    top_k: int = 100
    strategy: str = STRATEGY
    holdout: HoldoutConfig = HoldoutConfig()
    booster: BoosterParams = BoosterParams()
    depth_grid: tuple[int, ...] = (6, 8, 12)
    leaves_grid: tuple[int, ...] = (31, 63, 127)
    min_instances_grid: tuple[int, ...] = (20, 50, 150)
    #: Fits that run side by side, each in a scheduler pool of its own; 1 runs them one after another.
    parallel_fits: int = 4


class NotEnoughData(RuntimeError):
    """A guard on rows, positives or folds failed."""


@dataclass(frozen=True)
class TrainingRun:
    """The final model and its facts."""

    model: PipelineModel
    metadata: dict = field(default_factory=dict)


def with_residual(df: DataFrame, *, label: str = LABEL, baseline: str = BASELINE, out: str = "_target") -> DataFrame:
    """Label minus baseline in double, stored as float precision."""
    gap = F.col(label).cast("int").cast("double") - F.col(baseline).cast("double")
    return df.withColumn(out, gap.cast("float").cast("double"))


def blended(df: DataFrame, *, baseline: str = BASELINE, out: str = "score") -> DataFrame:
    """Baseline plus predicted residual, clamped."""
    return df.withColumn(out, blend(F.col(baseline), F.col("predicted"), F.lit(True)))


def greedy_search(
    start: BoosterParams,
    grid: dict[str, tuple[int, ...]],
    gain: Callable[[BoosterParams], float],
    each: Callable[[Callable, list], Iterable] = map,
) -> BoosterParams:
    """Settle one parameter after the other; of equal values the first wins, NaN loses.

    ``each`` maps over the choices of one parameter, which do not depend on one another.
    """
    seen: dict[BoosterParams, float] = {}
    best = start
    for name, choices in grid.items():
        if choices:
            tried = [replace(best, **{name: choice}) for choice in choices]
            new = [p for p in dict.fromkeys(tried) if p not in seen]
            seen.update((p, v if v == v else -1.0) for p, v in zip(new, each(gain, new)))
            best = max(tried, key=seen.__getitem__)
    return best


def side_by_side(spark: SparkSession, workers: int, label: str) -> Callable[[Callable, list], list]:
    """A ``map`` that runs calls at once, each in a scheduler pool of its own; results keep the order of the inputs.

    With the scheduler in FAIR mode the jobs of the pools share the executors.
    """

    def each(function: Callable, inputs: list) -> list:
        def call(number: int, value):
            before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{label}-{number}")
            try:
                return function(value)
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)

        inputs = list(inputs)
        if workers < 2 or len(inputs) < 2:
            return [function(value) for value in inputs]
        with ThreadPoolExecutor(min(workers, len(inputs))) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(call), i, v) for i, v in enumerate(inputs)]]

    return each


def run_id(content: str, config: TrainConfig, now: datetime) -> str:
    """Digest of the training content and the settings, with a readable time."""
    text = content + json.dumps(asdict(config), sort_keys=True, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()[:10]
    return f"run-{digest}-{now.strftime('%Y%m%dT%H%M%S')}"


def _guard(condition: bool, message: str) -> None:
    if not condition:
        raise NotEnoughData(message)


def train(frame: DataFrame, config: TrainConfig = TrainConfig(), *, today: date) -> TrainingRun:
    """Train on a point-in-time feature frame.

    The frame stays distributed; the driver sees window bounds, one metrics
    row per fit and the trees themselves.
    """
    if config.strategy != STRATEGY:
        raise ValueError(f"unsupported strategy {config.strategy!r}; only {STRATEGY!r} is known")
    features = feature_names(frame)
    _guard(BASELINE in features, f"the strategy needs the feature {BASELINE!r}")
    with kept(drop_open_rows(frame, today, start=DAY)) as closed:
        return _train_closed(closed, features, config)


def _train_closed(closed: DataFrame, features: list[str], config: TrainConfig) -> TrainingRun:
    n_closed = closed.count()
    _guard(n_closed >= config.min_rows, f"too few rows after right-censoring (n={n_closed})")
    window = find_holdout(closed, config.holdout)
    held = holdout_rows(closed, window)
    held_hash = content_hash(held).first()["sha256"] if window.found else ""
    rows = training_rows(
        closed,
        window,
        min_rows=config.min_rows,
        min_positives=config.min_positives,
        embargo_days=config.holdout_embargo_days,
    )
    _guard(rows.n_rows >= config.min_rows, f"too few training rows (n={rows.n_rows})")
    _guard(rows.n_positives >= config.min_positives, f"too few positives (n={rows.n_positives})")

    span = (rows.last_day - rows.first_day).days
    n_splits, horizon = fold_sizing(span, config.n_splits, config.embargo_days)
    folds = plan_folds(
        rows.first_day, rows.last_day, n_splits=n_splits, horizon_days=horizon, embargo_days=config.embargo_days
    )
    data = assembler(features).transform(with_residual(rows.frame)).select(
        "cve_id", DAY, LABEL, BASELINE, "_target", VECTOR
    )
    # Binned once for all folds and settings: the edges are quantiles of all rows before the holdout.
    edges = bin_edges(data, VECTOR, config.booster.max_bins)
    with kept(with_bins(data, VECTOR, edges)) as stored:
        tuned, models, per_fold, average = _run_folds(stored, edges, folds, config)

    # The last fold's fit is the final fit: same rows, same settings, same seed.
    last = max(models)
    final = models[last]
    now = datetime.now(timezone.utc)
    content = content_hash(rows.frame).first()["sha256"]
    found = window.found
    metadata = {
        "run_id": run_id(content, config, now),
        "model_version": MODEL_VERSION,
        "strategy": config.strategy,
        "task": "regression",
        "trained_at": now.isoformat(),
        "feature_names": features,
        "n_features": len(features),
        "n_rows": rows.n_rows,
        "n_rows_closed": n_closed,
        "n_positives": rows.n_positives,
        "holdout_leak": rows.holdout_leak,
        "heldout_n_rows": window.n_rows if found else 0,
        "heldout_n_positives": window.n_positives if found else 0,
        "heldout_window_start": window.start.isoformat() if found else None,
        "heldout_window_end": window.end.isoformat() if found else None,
        "heldout_window_days": window.window_days,
        "heldout_content_sha256": held_hash,
        "n_splits": n_splits,
        "horizon_days": horizon,
        "embargo_days": config.embargo_days,
        "seed": config.booster.seed,
        "params": asdict(config.booster),
        "fold_params": {str(k): asdict(v) for k, v in tuned.items()},
        "final_params": asdict(tuned[last]),
        "fold_metrics": per_fold,
        "avg_metrics": average,
        "final_valid_metrics": per_fold[-1],
        "feature_importance": importances(final, features),
    }
    return TrainingRun(as_pipeline(features, final), metadata)


def _run_folds(data: DataFrame, edges: list[list[float]], folds: Sequence[Fold], config: TrainConfig):
    """Tuned settings and model of every usable fold, metrics per fold, and their means."""
    summary = fold_summary(assign_folds(data.select(DAY, LABEL), folds, day=DAY), day=DAY, label=LABEL)
    # At most two rows per fold.
    positives = {(r["fold"], r["role"]): r["n_positives"] for r in summary.collect()}
    usable = [
        f
        for f in folds
        if positives.get((f.number, "train"), 0) >= 1 and positives.get((f.number, "valid"), 0) >= 1
    ]
    _guard(bool(usable), "no usable fold; check the label balance")
    spark = data.sparkSession

    def fit(fold: Fold):
        return _fit_fold(*fold_rows(data, fold, day=DAY), edges, config, f"fold-{fold.number}")

    fitted = side_by_side(spark, config.parallel_fits, "fold")(fit, usable)
    tuned = {fold.number: params for fold, (params, _) in zip(usable, fitted)}
    models = {fold.number: model for fold, (_, model) in zip(usable, fitted)}
    scored = []
    for fold in usable:
        made = blended(predicted(models[fold.number], fold_rows(data, fold, day=DAY)[1]))
        scored.append(made.select(F.lit(fold.number).alias("fold"), "cve_id", LABEL, "score"))
    # The metrics read the scores several times; the models run once.
    every = cut_lineage(reduce(DataFrame.unionByName, scored))
    metrics = metric_bundle(
        every, label=LABEL, score="score", k=config.top_k, tie_break=["cve_id"], groups=["fold"]
    )
    with kept(metrics) as table:
        per_fold = [r.asDict() for r in table.orderBy("fold").collect()]
        average = table.agg(*[F.avg(m).alias(m) for m in METRICS]).first().asDict()
    return tuned, models, per_fold, average


def _fit_fold(train_rows: DataFrame, valid: DataFrame, edges: list[list[float]], config: TrainConfig, label: str):
    grid = {"max_depth": config.depth_grid, "num_leaves": config.leaves_grid, "min_instances": config.min_instances_grid}
    if not config.booster.num_leaves:
        del grid["num_leaves"]
    fitted = {}

    def gain(params: BoosterParams) -> float:
        fitted[params] = fit_booster(train_rows, valid, target="_target", params=params, edges=edges)
        rows = cut_lineage(blended(predicted(fitted[params], valid)).select(LABEL, "score"))
        return evaluate(rows, label=LABEL, score="score").first()["auc_pr"]

    best = greedy_search(config.booster, grid, gain, side_by_side(train_rows.sparkSession, config.parallel_fits, label))
    if best not in fitted:
        fitted[best] = fit_booster(train_rows, valid, target="_target", params=best, edges=edges)
    return best, fitted[best]


def score_frame(frame: DataFrame, model: PipelineModel) -> DataFrame:
    """(cve_id, predicted residual) for every row of a feature frame."""
    return predicted(model, frame).select("cve_id", "predicted")
