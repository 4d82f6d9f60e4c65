"""Model and baseline on one holdout, and the ablation table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.assemble import feature_names
from riskloom.operators.holdout import (
    Holdout,
    HoldoutConfig,
    content_hash,
    find_holdout,
    holdout_rows,
    ordered_split,
)
from riskloom.operators.labels import drop_open_rows
from riskloom.operators.metrics import compare_models, metric_bundle
from riskloom.plans.boosting import BoosterParams, DegenerateTarget, assembler, fit_booster, predicted
from riskloom.plans.training import BASELINE, DAY, LABEL, STRATEGY, blended
from riskloom.session import cut_lineage, kept

# Fixed value: the gate fails when the baseline leads by more than this.
AUC_PR_MARGIN = 1.0
_REPORT = (
    "model string, n bigint, positives bigint, auc_pr double, auc_roc double, brier double, ece double, "
    "precision_at_k double, lift_auc_pr double, gate_passed boolean"
)
_FACTS = (
    "status string, reason string, note string, window_start date, window_end date, window_days int, "
    "closed_rows bigint, closed_first date, closed_last date, train_first date, train_last date, "
    "baseline_coverage double"
)


@dataclass(frozen=True)
class EvalConfig:
    """Settings shared by the comparison and the ablations."""

    top_k: int = 100
    margin: float = AUC_PR_MARGIN
    holdout: HoldoutConfig = HoldoutConfig()
    booster: BoosterParams = BoosterParams()


def _with_facts(table: DataFrame, facts: dict) -> DataFrame:
    types = dict(part.strip().split(" ") for part in _FACTS.split(","))
    return table.select(*[F.lit(facts.get(n)).cast(t).alias(n) for n, t in types.items()], "*")


def unavailable(spark: SparkSession, reason: str, facts: dict | None = None) -> DataFrame:
    """A result row that states why there are no metrics; the gate fails on it."""
    empty = spark.createDataFrame([(None,) * 9 + (False,)], _REPORT)
    return _with_facts(empty, {**(facts or {}), "status": "unavailable", "reason": reason})


def _closed_facts(closed: DataFrame, window: Holdout) -> dict:
    before = F.col(DAY) < F.lit(window.start) if window.found else F.lit(True)
    row = closed.agg(
        F.count(F.lit(1)).alias("closed_rows"),
        F.min(DAY).alias("closed_first"),
        F.max(DAY).alias("closed_last"),
        F.min(F.when(before, F.col(DAY))).alias("train_first"),
        F.max(F.when(before, F.col(DAY))).alias("train_last"),
    ).first()
    return {
        **row.asDict(),
        "window_start": window.start,
        "window_end": window.end,
        "window_days": window.window_days,
    }


def evaluate_model(
    frame: DataFrame,
    model: PipelineModel | None,
    metadata: dict | None,
    *,
    today: date,
    config: EvalConfig = EvalConfig(),
) -> DataFrame:
    """One row per model on the rolling holdout, or one row that says why not.

    Both models see the same rows and the same point-in-time baseline column;
    ``baseline_coverage`` is the share of rows for which that column is known.
    """
    if model is None or metadata is None:
        return unavailable(frame.sparkSession, "no trained model found")
    with kept(drop_open_rows(frame, today, start=DAY)) as closed:
        return _evaluate_closed(closed, model, metadata, config)


def _evaluate_closed(
    closed: DataFrame, model: PipelineModel, metadata: dict, config: EvalConfig
) -> DataFrame:
    spark = closed.sparkSession
    window = find_holdout(closed, config.holdout)
    facts = _closed_facts(closed, window)
    if not window.found:
        return unavailable(spark, window.reason, facts)
    held = holdout_rows(closed, window)
    missing = [c for c in metadata["feature_names"] if c not in held.columns]
    if missing:
        return unavailable(spark, f"the frame lacks the model's features {missing}", facts)
    expected, actual = metadata.get("heldout_content_sha256"), content_hash(held).first()["sha256"]
    note = None
    if expected and expected != actual:
        note = f"holdout content differs from training: {expected[:12]} then, {actual[:12]} now"
    residual = metadata.get("strategy") == STRATEGY and metadata.get("task") == "regression"
    scored = predicted(model, held, task="regression" if residual else "classification")
    scored = blended(scored) if residual else scored.withColumn("score", F.col("predicted"))
    # The metrics read the scores several times; the model runs once.
    table = compare_models(
        cut_lineage(scored.select("cve_id", LABEL, BASELINE, "score")),
        {"model": "score", "baseline": BASELINE},
        label=LABEL,
        baseline="baseline",
        k=config.top_k,
        tie_break=["cve_id"],
        margin=config.margin,
    )
    coverage = held.agg(F.avg((F.col(BASELINE) > 0).cast("double"))).first()[0]
    return _with_facts(table, {**facts, "status": "ok", "note": note, "baseline_coverage": coverage})


def gate(report: DataFrame) -> DataFrame:
    """One row: whether the model's row exists and passes."""
    return report.agg(
        F.coalesce(
            F.bool_and(F.when(F.col("model") == "model", F.col("gate_passed"))), F.lit(False)
        ).alias("passed")
    )


def fit_ablation_classifier(train: DataFrame, features: list[str], params: BoosterParams):
    """A plain classifier on the earlier 80 %, stopped early on the rest; ``None`` when too thin."""
    n, positives = train.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col(LABEL).cast("int")), F.lit(0))
    ).first()
    if n < 50 or positives < 3:
        return None
    rows = assembler(features).transform(train.withColumn("_y", F.col(LABEL).cast("double")))
    with kept(ordered_split(rows)) as split:
        try:
            return fit_booster(
                split.where("is_train"),
                split.where("not is_train"),
                target="_y",
                params=params,
                task="classification",
            )
        except DegenerateTarget:
            return None


def ablations(
    frame: DataFrame,
    model: PipelineModel | None,
    metadata: dict | None,
    *,
    today: date,
    config: EvalConfig = EvalConfig(),
) -> DataFrame:
    """One row per variant with its metrics, or with a note where it could not be made."""
    with kept(drop_open_rows(frame, today, start=DAY)) as closed:
        return _ablate_closed(closed, model, metadata, config)


def _ablate_closed(
    closed: DataFrame, model: PipelineModel | None, metadata: dict | None, config: EvalConfig
) -> DataFrame:
    spark = closed.sparkSession
    columns = "variant string, auc_pr double, auc_roc double, precision_at_k double, brier double, note string"
    window = find_holdout(closed, config.holdout)
    if not window.found or BASELINE not in closed.columns:
        reason = window.reason or f"the frame lacks {BASELINE}"
        return spark.createDataFrame([("all", None, None, None, None, reason)], columns)
    held = holdout_rows(closed, window)
    train = closed.where(F.col(DAY) < F.lit(window.start))
    plain = held.select("cve_id", LABEL, F.col(BASELINE).cast("double").alias("score"))
    variants = {"baseline_only": plain}
    notes: dict[str, str] = {}
    for name, features in (
        ("full", feature_names(closed)),
        ("no_baseline", feature_names(closed, without_epss=True)),
    ):
        if len(features) < 2:
            notes[name] = "too few features"
            continue
        fitted = fit_ablation_classifier(train, features, config.booster)
        if fitted is None:
            notes[name] = "too few rows or a single class before the holdout"
            continue
        rows = predicted(fitted, assembler(features).transform(held), task="classification")
        variants[name] = rows.select("cve_id", LABEL, F.col("predicted").alias("score"))
    if model is None or metadata is None:
        notes["complement"] = "no trained model found"
    elif metadata.get("strategy") != STRATEGY or metadata.get("task") != "regression":
        notes["complement"] = "the latest model is no residual model"
    elif any(c not in held.columns for c in metadata["feature_names"]):
        notes["complement"] = "the frame lacks features of the latest model"
    else:
        variants["complement"] = blended(predicted(model, held)).select("cve_id", LABEL, "score")
    every = reduce(
        DataFrame.unionByName,
        [part.withColumn("variant", F.lit(name)) for name, part in variants.items()],
    )
    made = metric_bundle(
        cut_lineage(every), label=LABEL, score="score", k=config.top_k, tie_break=["cve_id"], groups=["variant"]
    ).select("variant", "auc_pr", "auc_roc", "precision_at_k", "brier", F.lit(None).cast("string").alias("note"))
    if not notes:
        return made
    lacking = spark.createDataFrame(
        [(name, None, None, None, None, note) for name, note in notes.items()], columns
    )
    return made.unionByName(lacking)
