"""Horizon label and right-censoring."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.dedup import keep_first

# Fixed value: days after publication within which an exploit counts.
HORIZON_DAYS = 30


def label_within_horizon(
    df: DataFrame,
    marks: DataFrame,
    *,
    key: str = "cve_id",
    start: str = "published_date",
    mark_date: str = "date_added",
    horizon_days: int = HORIZON_DAYS,
    date_as: str = "kev_date_added",
    flag_as: str = "in_kev",
    label_as: str = "exploited_30d",
    mark_order: tuple[str, ...] | None = None,
    marks_unique: bool = False,
) -> DataFrame:
    """Left-join the first mark per key and label rows marked by ``start`` + horizon.

    The horizon is inclusive and has no lower bound: a mark before ``start``
    is positive. ``marks`` is joined by size: Spark broadcasts it below the
    session's threshold and shuffles both sides above it. ``marks_unique`` says
    that it holds a key once.
    """
    for frame, columns, name in ((df, (key, start), "df"), (marks, (key, mark_date), "marks")):
        missing = [c for c in columns if c not in frame.columns]
        if missing:
            raise ValueError(f"{name} lacks columns {missing}")
    order = mark_order or (mark_date,)
    known = marks.where(F.col(key).isNotNull())
    first = (known if marks_unique else keep_first(known, [key], order)).select(key, F.col(mark_date).alias(date_as))
    last_day = F.date_add(F.col(start), horizon_days)
    return (
        df.join(first, key, "left")
        .withColumn(flag_as, F.col(date_as).isNotNull())
        .withColumn(label_as, F.coalesce(F.col(date_as) <= last_day, F.lit(False)))
    )


def closed(start: Column, today: date | Column, horizon_days: int = HORIZON_DAYS) -> Column:
    """Whether a row's label window has closed by ``today``."""
    day = today if isinstance(today, Column) else F.lit(today)
    return start <= F.date_sub(day, horizon_days)


def drop_open_rows(
    df: DataFrame, today: date | Column, *, start: str = "published_date", horizon_days: int = HORIZON_DAYS
) -> DataFrame:
    """Rows whose label can no longer change."""
    return df.where(closed(F.col(start), today, horizon_days))
