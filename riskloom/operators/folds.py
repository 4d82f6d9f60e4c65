"""Embargoed forward-chaining folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Validation span and the last day its training rows may have."""

    number: int
    train_until: date
    valid_from: date
    valid_until: date


def plan_folds(
    first: date | None, last: date | None, *, n_splits: int, horizon_days: int, embargo_days: int
) -> list[Fold]:
    """The last ``n_splits * horizon_days`` days in equal blocks, oldest first."""
    if min(n_splits, horizon_days) < 1 or embargo_days < 0:
        raise ValueError(f"cannot plan {n_splits} folds of {horizon_days} days after an embargo of {embargo_days}")
    if first is None or last is None:
        raise ValueError("a table without dates has no folds")
    span, needed = (last - first).days, n_splits * horizon_days + embargo_days
    if span < needed:
        raise ValueError(f"the table spans {span} days; the folds and the embargo take {needed}")
    folds = []
    for number in range(n_splits):
        until = last - timedelta(days=(n_splits - 1 - number) * horizon_days)
        start = until - timedelta(days=horizon_days - 1)
        folds.append(Fold(number, start - timedelta(days=embargo_days + 1), start, until))
    return folds


def fold_sizing(span_days: int, n_splits: int, embargo_days: int) -> tuple[int, int]:
    """``(n_splits, horizon_days)`` that fit the span.

    The span is shared out among the folds and one part for the first training
    rows, in parts of at least 30 days. If those and the embargo exceed the
    span, as many folds stay as fit with an embargo each, two at least.
    """
    shares = 1 + max(n_splits, 1)
    horizon = max(span_days // shares, 30)
    fits = horizon * (1 + n_splits) + embargo_days <= span_days
    return (n_splits if fits else max(span_days // (embargo_days + horizon), 2)), horizon


def fold_rows(rows: DataFrame, fold: Fold, *, day: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold, as filters on the same table."""
    d = F.col(day)
    return (
        rows.where(d <= F.lit(fold.train_until)),
        rows.where(d.between(F.lit(fold.valid_from), F.lit(fold.valid_until))),
    )


def assign_folds(rows: DataFrame, folds: Sequence[Fold], *, day: str) -> DataFrame:
    """One row per (row, fold it takes part in) with ``fold`` and ``role``."""
    d = F.col(day)
    parts = [
        F.when(
            (d <= F.lit(f.train_until)) | d.between(F.lit(f.valid_from), F.lit(f.valid_until)),
            F.struct(
                F.lit(f.number).alias("fold"),
                F.when(d <= F.lit(f.train_until), "train").otherwise("valid").alias("role"),
            ),
        )
        for f in folds
    ]
    return rows.select("*", F.inline(F.filter(F.array(*parts), lambda part: part.isNotNull())))


def fold_summary(assigned: DataFrame, *, day: str, label: str | None = None) -> DataFrame:
    """Rows, positives and date range of every (fold, role)."""
    positives = F.sum(F.col(label).cast("int")) if label else F.lit(None).cast("long")
    return assigned.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        positives.alias("n_positives"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )
