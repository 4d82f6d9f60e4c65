"""Boosted trees and calibrators on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import clamp01
from riskloom.operators.isotonic import isotonic_blocks, isotonic_value
from riskloom.plans.leafwise import bin_edges, fit_leafwise, with_bins

Task = Literal["regression", "classification"]
VECTOR = "_features"


@dataclass(frozen=True)
class BoosterParams:
    """Booster settings. Trees grow best leaf first up to ``num_leaves``, or level by level if that is 0."""

    max_iter: int = 50
    max_depth: int = 6
    num_leaves: int = 31
    min_instances: int = 50
    step_size: float = 0.05
    subsampling: float = 0.8
    feature_share: float = 0.9
    patience: int = 50
    max_bins: int = 64
    seed: int = 42


class DegenerateTarget(ValueError):
    """The training target has a single value."""


def assembler(features: Sequence[str]) -> VectorAssembler:
    """The named columns as one vector."""
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR)


def _best_round(errors: Sequence[float], patience: int) -> int:
    """Number of rounds to keep: the best one before ``patience`` rounds bring no gain."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_booster(
    train: DataFrame,
    valid: DataFrame | None,
    *,
    target: str,
    params: BoosterParams,
    task: Task = "regression",
    edges: Sequence[Sequence[float]] | None = None,
):
    """Fit on rows that carry the assembled vector; validation only stops the boosting early.

    The validation error of every round is known from one fit; the ensemble is cut after the best one. With ``edges`` the
    rows have been binned by them already.
    """
    low, high = train.agg(F.min(target), F.max(target)).first()
    if low is None or low == high:
        raise DegenerateTarget(f"target '{target}' is constant or empty; nothing to fit")
    if params.num_leaves:
        if edges is None:
            edges = bin_edges(train, VECTOR, params.max_bins)
            train = with_bins(train, VECTOR, edges)
            valid = with_bins(valid, VECTOR, edges) if valid is not None else None
        return fit_leafwise(
            train,
            valid,
            edges,
            target=target,
            vector=VECTOR,
            task=task,
            rounds=params.max_iter,
            leaves=params.num_leaves,
            depth=params.max_depth,
            min_instances=params.min_instances,
            step_size=params.step_size,
            subsampling=params.subsampling,
            feature_share=params.feature_share,
            patience=params.patience,
            seed=params.seed,
        )
    model = level_booster(target, params, task).fit(train)
    if valid is None or valid.isEmpty():
        return model
    if task == "regression":
        errors = model.evaluateEachIteration(valid, "squared")
    else:
        errors = model.evaluateEachIteration(valid)
    return first_rounds(model, _best_round(errors, params.patience))


def level_booster(target: str, params: BoosterParams, task: Task = "regression"):
    """Spark ML's own booster, whose trees grow level by level."""
    kind = GBTRegressor if task == "regression" else GBTClassifier
    return kind(
        featuresCol=VECTOR,
        labelCol=target,
        maxIter=params.max_iter,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_instances,
        stepSize=params.step_size,
        subsamplingRate=params.subsampling,
        featureSubsetStrategy=str(params.feature_share) if params.feature_share < 1 else "all",
        maxBins=params.max_bins,
        seed=params.seed,
    )


def first_rounds(model, rounds: int):
    """The ensemble of the first trees and weights; trees do not depend on later ones, so a shorter fit gives the same."""
    trees, weights = model._java_obj.trees(), model._java_obj.treeWeights()
    if rounds >= len(trees):
        return model
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kept_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        kept_trees[i], kept_weights[i] = trees[i], weights[i]
    uid, size = f"{model.uid}_first_{rounds}", model.numFeatures
    if isinstance(model, GBTRegressionModel):
        made = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, kept_trees, kept_weights))
    else:
        made = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, kept_trees, kept_weights, size, 2))
    return model._copyValues(made)


def predicted(model, rows: DataFrame, *, task: Task = "regression", out: str = "predicted") -> DataFrame:
    """Raw residual of a regressor or positive-class probability of a classifier, as ``out``."""
    made = model.transform(rows)
    if task == "regression":
        return made.withColumn(out, F.col("prediction").cast("double")).drop("prediction")
    return made.withColumn(out, vector_to_array("probability")[1]).drop(
        "prediction", "probability", "rawPrediction"
    )


def as_pipeline(features: Sequence[str], model) -> PipelineModel:
    """Assembler and booster as one model that can be saved."""
    return PipelineModel([assembler(features), model])


def importances(model, features: Sequence[str]) -> dict[str, float]:
    """Gain per feature: how much its splits lower the sum of squares that each tree was fitted to."""
    gains = [0.0] * len(features)
    for tree in model._java_obj.trees():
        open_nodes = [tree.rootNode()]
        while open_nodes:
            node = open_nodes.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                gains[node.split().featureIndex()] += node.gain() * node.impurityStats().count()
                open_nodes += [node.leftChild(), node.rightChild()]
    return dict(zip(features, gains))


class Calibrator:
    """Adds a calibrated probability to rows with a score column."""

    def __init__(self, method: str, model=None) -> None:
        self.method = method
        self.model = model

    def transform(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        """``df`` with ``out``; scores outside the fitted range take the nearest fitted value."""
        if self.model is None:
            return df.withColumn(out, clamp01(F.col(score)))
        if self.method == "isotonic":
            return isotonic_value(df, self.model, score=score, out=out)
        rows = VectorAssembler(inputCols=[score], outputCol="_x").transform(df)
        return self.model.transform(rows).select(*df.columns, vector_to_array("probability")[1].alias(out))


def fit_calibrator(
    df: DataFrame, *, score: str, label: str, method: Literal["isotonic", "sigmoid"] = "isotonic"
) -> Calibrator:
    """Isotonic or logistic map from score to probability; identity when there is one class.

    Rows are added up per score and label first. The isotonic map stays a table of blocks.
    """
    y: Column = F.col(label).cast("double")
    weighted = (
        df.groupBy(F.col(score).cast("double").alias("_x"), y.alias("_y"))
        .agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )
    low, high, n = weighted.agg(F.min("_y"), F.max("_y"), F.sum("_w")).first()
    if n is None or low == high:
        return Calibrator("identity")
    if method == "isotonic":
        return Calibrator(method, isotonic_blocks(df, score=score, label=label))
    if method == "sigmoid":
        rows = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(weighted)
        # A ridge of 1/n on the mean loss is a unit ridge on the summed loss.
        fitted = LogisticRegression(
            featuresCol="_v", labelCol="_y", weightCol="_w", regParam=1.0 / n, standardization=False, tol=1e-9
        ).fit(rows)
        return Calibrator(method, fitted.setFeaturesCol("_x"))
    raise ValueError(f"unknown calibration method: {method!r}")
