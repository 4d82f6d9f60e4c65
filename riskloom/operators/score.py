"""Baseline-plus-residual scores for requested ids, and ranks within documents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import clamp01
from riskloom.operators.ordering import number_along

Kind = Literal["residual", "probability"]


def baseline_lookup(requests: DataFrame, baseline: DataFrame, *, key: str = "cve_id") -> DataFrame:
    """Baseline score and percentile of each request; unknown ids get 0 and ``known`` false."""
    table = baseline.select(
        key,
        F.col("epss_score").cast("double").alias("_s"),
        F.col("epss_percentile").cast("double").alias("_q"),
        F.lit(True).alias("_known"),
    )
    zero = F.lit(0.0)
    return (
        requests.join(table, key, "left")
        .withColumn("epss_score", F.coalesce("_s", zero))
        .withColumn("epss_percentile", F.coalesce("_q", zero))
        .withColumn("known", F.coalesce("_known", F.lit(False)))
        .drop("_s", "_q", "_known")
    )


def blend(epss: Column, predicted: Column, known: Column, kind: Kind = "residual") -> Column:
    """Baseline plus residual where the model speaks, else the baseline, else 0."""
    base = epss.cast("double")
    modelled = base + predicted.cast("double") if kind == "residual" else predicted.cast("double")
    return (
        F.when(predicted.isNotNull(), clamp01(modelled))
        .when(known, clamp01(base))
        .otherwise(F.lit(0.0))
    )


def score_ids(
    requests: DataFrame,
    master: DataFrame,
    predictions: DataFrame | None = None,
    *,
    key: str = "cve_id",
    kind: Kind = "residual",
) -> DataFrame:
    """Requests (other columns, order and duplicates kept) with their scores.

    ``master`` holds one row per id with the baseline score, percentile, exploit
    flag and base score; ``predictions`` holds ``predicted`` for ids with features.
    Scores are worked out once per id of the two tables, and requests are read once.
    """
    found = master.select(
        key, "epss_score", "epss_percentile", "in_kev", "cvss_v3_base_score", F.lit(True).alias("_known")
    ).where(F.col(key).isNotNull())
    if predictions is None:
        found = found.withColumn("predicted", F.lit(None).cast("double"))
    else:
        found = found.join(predictions.select(key, "predicted").where(F.col(key).isNotNull()), key, "full")
    known = F.coalesce("_known", F.lit(False))
    epss = F.coalesce(F.col("epss_score").cast("double"), F.lit(0.0))
    scored = found.select(
        key,
        blend(epss, F.col("predicted"), known, kind).alias("probability"),
        clamp01(F.col("epss_percentile")).alias("percentile"),
        F.coalesce("in_kev", F.lit(False)).alias("in_kev"),
        F.col("cvss_v3_base_score").cast("double").alias("cvss_v3_base_score"),
    )
    zero = F.lit(0.0)
    return (
        requests.join(scored, key, "left")
        .withColumn("probability", F.coalesce("probability", zero))
        .withColumn("percentile", F.coalesce("percentile", zero))
        .withColumn("in_kev", F.coalesce("in_kev", F.lit(False)))
    )


def rank_matches(
    scored: DataFrame,
    *,
    doc: str = "doc_id",
    key: str = "cve_id",
    ties: Sequence[str] = ("tier", "pos"),
    slices: int | None = None,
) -> DataFrame:
    """Add ``rank``: probability, then base score (null as 0), both descending, then id and ``ties``.

    A very long document is shared by many tasks, by ranges of that whole order, whatever its probabilities.
    """
    order = [
        F.col("probability").desc(),
        F.coalesce("cvss_v3_base_score", F.lit(0.0)).desc(),
        F.col(key).asc(),
        *[F.col(c).asc() for c in ties],
    ]
    return number_along(scored, order, groups=[doc], out="rank", slices=slices)
