"""Calendar features and same-week / same-month counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import iso_weekday

COUNTS = ("f_cves_published_same_week", "f_cves_published_same_month")
FEATURES = ("f_cve_year", "f_cve_month", "f_cve_weekday", "f_age_days", *COUNTS)


def latest_day(df: DataFrame, day: str) -> Column:
    """The largest date as a scalar subquery."""
    return df.agg(F.max(day)).scalar()


def _daily(df: DataFrame, day: str, iso_year: bool) -> DataFrame:
    # By default a week is (calendar year, ISO week), so that the last days of
    # December may share a bucket with early January of the same year.
    year = F.extract(F.lit("YEAROFWEEK"), F.col("_day")) if iso_year else F.year("_day")
    return (
        df.groupBy(F.col(day).cast("date").alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_day").isNotNull())
        .withColumn("_week_year", year)
        .withColumn("_week", F.weekofyear("_day"))
        .withColumn("_year", F.year("_day"))
        .withColumn("_month", F.month("_day"))
    )


def _with_counts(df: DataFrame, daily: DataFrame, day: str, upto_own_day: bool) -> DataFrame:
    def total(*bucket: str) -> Column:
        window = Window.partitionBy(*bucket)
        if upto_own_day:
            window = window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_n").over(window).cast("int")

    counts = daily.select(
        "_day",
        total("_week_year", "_week").alias(COUNTS[0]),
        total("_year", "_month").alias(COUNTS[1]),
    )
    # One row per calendar day: DateType holds fewer than 3.7 million days, so
    # the broadcast stays below 100 MB whatever the size of the input.
    return df.join(F.broadcast(counts), F.col(day).cast("date") == F.col("_day"), "left").drop("_day")


def _finish(df: DataFrame, day: str, as_of: Column) -> DataFrame:
    d = F.col(day)
    return (
        df.withColumn("f_cve_year", F.year(d).cast("int"))
        .withColumn("f_cve_month", F.month(d).cast("int"))
        .withColumn("f_cve_weekday", iso_weekday(d))
        .withColumn("f_age_days", F.datediff(as_of, d).cast("int"))
    )


def temporal_per_row(
    df: DataFrame,
    *,
    day: str = "published_date",
    iso_year: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Features as of each row's own day: counts include that day and nothing later.

    Rows are first counted per day, so the windows run over days, and a busy
    day is one row of the count table. Rows without a date have null features.
    ``counted`` names the table to count when ``df`` is that table with joined
    columns, so that those joins do not run again for the counts.
    """
    daily = _daily(df if counted is None else counted, day, iso_year)
    with_counts = _with_counts(df, daily, day, upto_own_day=True)
    return _finish(with_counts, day, F.col(day)).select(*df.columns, *FEATURES)


def temporal_as_of(
    df: DataFrame,
    as_of: date | Column | None = None,
    *,
    day: str = "published_date",
    iso_year: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Features of the rows visible at one ``as_of`` (default: the latest day)."""
    source = df if counted is None else counted
    if as_of is None:
        as_of = latest_day(source, day)
    anchor = as_of if isinstance(as_of, Column) else F.lit(as_of)
    daily = _daily(source.where(F.col(day) <= anchor), day, iso_year)
    with_counts = _with_counts(df.where(F.col(day) <= anchor), daily, day, upto_own_day=False)
    return _finish(with_counts, day, anchor).select(*df.columns, *FEATURES)
