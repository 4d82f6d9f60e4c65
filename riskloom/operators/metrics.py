"""Ranking and calibration metrics over (label, score) rows, grouped or not.

Rows are first added up per distinct score, so ties follow the rule of
distinct thresholds and a score shared by many rows is one row afterwards.
Labels are 0/1 or boolean; scores must be non-null and not NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import clamp01
from riskloom.operators.ordering import (
    null_safe_join,
    running_totals,
    slice_count,
    slice_edges,
)
from riskloom.session import cut_lineage

NAN = float("nan")


def _rows(df: DataFrame, label: str, score: str, groups: Sequence[str], *extra: str) -> DataFrame:
    return df.select(
        *groups,
        F.col(label).cast("int").alias("_y"),
        F.col(score).cast("double").alias("_p"),
        *[F.col(name) for name in extra if name not in groups],
    )


def score_curve(
    df: DataFrame, *, label: str, score: str, groups: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Positives and rows at each distinct score and, from the highest down, up to it.

    The rows are read once: slice edges and totals come from the sums per score.
    """
    sums = cut_lineage(
        _rows(df, label, score, groups).groupBy(*groups, "_p").agg(F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    )
    edges = slice_edges(sums, "_p", slices if slices is not None else slice_count(df))
    return running_totals(sums, by="_p", values=["_pos", "_n"], groups=groups, edges=edges)


def calibration_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin of ``p`` in [0, 1]: half-open, the last one closed.

    The edges are ``i / bins`` built as ``i * (1 / bins)``, so 0.3 lies below
    the fourth edge of ten bins; ``floor(p * bins)`` alone would misplace it.
    """
    step = 1.0 / bins
    guess = F.floor(p * bins)
    low = guess.cast("double") * F.lit(step)
    high = (guess.cast("double") + 1) * F.lit(step)
    placed = F.when(p < low, guess - 1).when(p >= high, guess + 1).otherwise(guess)
    return F.least(F.greatest(placed, F.lit(0)), F.lit(bins - 1)).cast("int")


def _ratio(value: Column, divisor: Column) -> Column:
    return F.when(divisor > 0, value / divisor).otherwise(F.lit(NAN))


def _gap_sum(weight: str, hits: str) -> Column:
    return F.sum(F.abs(F.col(weight) - F.col(hits)))


def evaluate(
    df: DataFrame,
    *,
    label: str,
    score: str,
    groups: Sequence[str] = (),
    bins: int = 10,
    slices: int | None = None,
) -> DataFrame:
    """One row per group: n, positives, auc_pr, auc_roc, brier, ece.

    AUC-PR is the step sum over distinct thresholds; AUC-ROC gives ties half
    credit; both are NaN when a group has a single class.
    """
    return summarise(score_curve(df, label=label, score=score, groups=groups, slices=slices), groups, bins)


def summarise(curve: DataFrame, groups: Sequence[str], bins: int = 10) -> DataFrame:
    """The metrics of ``evaluate`` from a score curve."""
    p = clamp01(F.col("_p"))
    pos, n = F.col("_pos").cast("double"), F.col("_n").cast("double")
    cum_pos, cum_n = F.col("cum__pos").cast("double"), F.col("cum__n").cast("double")
    per_bin = (
        curve.withColumn("_bin", calibration_bin(p, bins))
        .groupBy(*groups, "_bin")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum("_pos").alias("_pos"),
            F.sum(n * p).alias("_conf"),
            F.sum(pos * cum_pos / cum_n).alias("_ap"),
            F.sum((n - pos) * (cum_pos - pos / 2)).alias("_wins"),
            F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p).alias("_sq"),
        )
    )
    totals = per_bin.groupBy(*groups).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"),
        F.sum("_ap").alias("_ap"),
        F.sum("_wins").alias("_wins"),
        F.sum("_sq").alias("_sq"),
        _gap_sum("_conf", "_pos").alias("_gap"),
    )
    positives, negatives = F.col("positives"), F.col("n") - F.col("positives")
    two_classes = (positives > 0) & (negatives > 0)
    pairs = positives.cast("double") * negatives.cast("double")
    return totals.select(
        *groups,
        "n",
        "positives",
        F.when(two_classes, F.col("_ap") / positives).otherwise(F.lit(NAN)).alias("auc_pr"),
        F.when(two_classes, F.col("_wins") / pairs).otherwise(F.lit(NAN)).alias("auc_roc"),
        _ratio(F.col("_sq"), F.col("n")).alias("brier"),
        _ratio(F.col("_gap"), F.col("n")).alias("ece"),
    )


def brier(df: DataFrame, *, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the clipped score; one map-side aggregation."""
    error = clamp01(F.col("_p")) - F.col("_y")
    mean = F.coalesce(F.avg(error * error), F.lit(NAN))
    return _rows(df, label, score, groups).groupBy(*groups).agg(mean.alias("brier"))


def calibration_table(
    df: DataFrame, *, label: str, score: str, groups: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Row count, summed confidence and positives of each non-empty bin."""
    p = clamp01(F.col("_p"))
    return (
        _rows(df, label, score, groups)
        .withColumn("bin", calibration_bin(p, bins))
        .groupBy(*groups, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(p).alias("confidence"),
            F.sum("_y").alias("positives"),
        )
    )


def calibration_error(
    df: DataFrame, *, label: str, score: str, groups: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    table = calibration_table(df, label=label, score=score, groups=groups, bins=bins)
    return table.groupBy(*groups).agg(
        F.coalesce(_gap_sum("confidence", "positives") / F.sum("n"), F.lit(NAN)).alias("ece")
    )


def precision_at_k(
    df: DataFrame,
    *,
    label: str,
    score: str,
    k: int,
    tie_break: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Share of positives among the ``min(k, n)`` best rows of each group; NaN for ``k <= 0``."""
    curve = score_curve(df, label=label, score=score, groups=groups)
    return _top_of_curve(curve, df, label=label, score=score, k=k, tie_break=tie_break, groups=groups)


def _top_of_curve(
    curve: DataFrame, df: DataFrame, *, label: str, score: str, k: int, tie_break: Sequence[str], groups: Sequence[str]
) -> DataFrame:
    """Whole scores count from the curve; ties are only broken among rows of the score that the k-th row has."""
    if k <= 0:
        return curve.groupBy(*groups).agg(F.lit(NAN).alias("precision_at_k"))
    whole = F.col("cum__n") <= k
    cut = ~whole & (F.col("cum__n") - F.col("_n") < k)
    top = curve.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(whole, F.col("_pos"))), F.lit(0)).alias("_top_pos"),
        F.coalesce(F.sum(F.when(whole, F.col("_n"))), F.lit(0)).alias("_top_n"),
        F.max(F.when(cut, F.col("_p"))).alias("_edge"),
    )
    edge = top.where(F.col("_edge").isNotNull()).select(*groups, F.col("_edge").alias("_p"), (k - F.col("_top_n")).alias("_left"))
    rows = _rows(df, label, score, groups, *tie_break)
    tied = null_safe_join(rows, edge, [*groups, "_p"])
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*([F.col(c).asc() for c in tie_break] or [F.lit(0)])))
    taken = tied.withColumn("_rank", rank).where((F.col("_rank") <= k) & (F.col("_rank") <= F.col("_left")))
    ties = taken.groupBy(*groups).agg(F.sum("_y").alias("_tie_pos"), F.count(F.lit(1)).alias("_tie_n"))
    counted = top.select(*groups, F.col("_top_pos").alias("_pos"), F.col("_top_n").alias("_n")).unionByName(
        ties.select(*groups, F.col("_tie_pos").alias("_pos"), F.col("_tie_n").alias("_n"))
    )
    # At most two rows per group.
    return counted.groupBy(*groups).agg(_ratio(F.sum("_pos"), F.sum("_n")).alias("precision_at_k"))


def metric_bundle(
    df: DataFrame,
    *,
    label: str,
    score: str,
    k: int,
    tie_break: Sequence[str],
    groups: Sequence[str],
    bins: int = 10,
) -> DataFrame:
    """All five metrics, one row per group."""
    curve = score_curve(df, label=label, score=score, groups=groups)
    summary = summarise(curve, groups, bins)
    top = _top_of_curve(curve, df, label=label, score=score, k=k, tie_break=tie_break, groups=groups)
    return null_safe_join(summary, top, groups, "left")


def long_scores(
    df: DataFrame, scores: Mapping[str, str], *, label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per (row, model): ``model``, ``score``, the label and the kept columns."""
    each = F.array(
        *[
            F.struct(F.lit(model).alias("model"), F.col(column).cast("double").alias("score"))
            for model, column in scores.items()
        ]
    )
    return df.select(label, *keep, F.inline(each))


def compare_models(
    df: DataFrame,
    scores: Mapping[str, str],
    *,
    label: str,
    baseline: str,
    k: int,
    tie_break: Sequence[str],
    margin: float = 1.0,
    bins: int = 10,
) -> DataFrame:
    """Metrics of every model on the same rows, the lift over ``baseline`` and the gate.

    ``gate_passed`` is false when the baseline leads by more than ``margin`` or
    when either value is missing.
    """
    table = metric_bundle(
        long_scores(df, scores, label=label, keep=tie_break),
        label=label,
        score="score",
        k=k,
        tie_break=tie_break,
        groups=["model"],
        bins=bins,
    )
    # One row per model, so a single window is enough.
    reference = F.max(F.when(F.col("model") == baseline, F.col("auc_pr"))).over(Window.partitionBy())
    lift = F.col("auc_pr") - reference
    passed = F.coalesce(~F.isnan(lift) & (-lift <= margin), F.lit(False))
    return table.withColumn("lift_auc_pr", lift).withColumn("gate_passed", passed)
