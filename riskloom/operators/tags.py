"""Popularity of the tags (weakness classes) a row carries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.temporal import latest_day

FEATURES = ("f_max_cwe_popularity", "f_mean_cwe_popularity", "f_cwe_distinct_count")


TAG_COUNT = "_tag_count"
NULL_SPREAD = 4096


def explode_tags(df: DataFrame, *, key: str, day: str, tags: str) -> DataFrame:
    """One row per (row, tag); a row without tags gives one row with a null tag.

    Each row also carries how many different tags it has, so that nobody has
    to count distinct values again after the explode.
    """
    different = F.size(F.array_distinct(F.filter(tags, lambda t: t.isNotNull())))
    return df.select(
        key,
        day,
        F.when(F.col(tags).isNull(), F.lit(0)).otherwise(different).alias(TAG_COUNT),
        F.explode_outer(tags).alias("_tag"),
    )


def _tag_rows(tagged: DataFrame, key: str, tag: str, *more: Column) -> DataFrame:
    counts = [TAG_COUNT] if TAG_COUNT in tagged.columns else []
    return tagged.select(key, *more, F.col(tag).alias("_tag"), *counts)


def _rate(rows: DataFrame, counts: DataFrame, key: str, *also: str) -> DataFrame:
    """Left-join the popularity; rows without a tag are spread instead of meeting in one task."""
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(key), F.lit(NULL_SPREAD)).cast("string"))
    spread_rows = rows.withColumn("_match", F.coalesce(F.col("_tag").cast("string"), apart))
    named = counts.withColumn("_match", F.col("_tag").cast("string")).drop("_tag")
    return spread_rows.join(named, ["_match", *also], "left")


def _summarise(rated: DataFrame, key: str) -> DataFrame:
    popularity = F.coalesce("_popularity", F.lit(0))
    known = TAG_COUNT in rated.columns
    different = F.max(TAG_COUNT) if known else F.countDistinct("_tag")
    return rated.groupBy(key).agg(
        F.max(popularity).cast("int").alias(FEATURES[0]),
        F.avg(popularity).cast("float").alias(FEATURES[1]),
        different.cast("int").alias(FEATURES[2]),
    )


def popularity_per_row(tagged: DataFrame, *, key: str, day: str, tag: str = "_tag") -> DataFrame:
    """Summaries where a tag's popularity counts the rows dated up to each row's own day.

    ``tagged`` has one row per (row, tag). Counting per (tag, day) first keeps
    the cumulative window at one row per day, however popular the tag is.
    """
    rows = _tag_rows(tagged, key, tag, F.col(day).cast("date").alias("_day")).where(
        F.col("_day").isNotNull()
    )
    upto = (
        Window.partitionBy("_tag")
        .orderBy("_day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = (
        rows.where(F.col("_tag").isNotNull())
        .groupBy("_tag", "_day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_tag", "_day", F.sum("_n").over(upto).alias("_popularity"))
    )
    return _summarise(_rate(rows, counts, key, "_day"), key)


def popularity_as_of(
    tagged: DataFrame,
    as_of: date | Column | None = None,
    *,
    key: str,
    day: str,
    tag: str = "_tag",
) -> DataFrame:
    """Summaries over the rows visible at one ``as_of`` (default: the latest day)."""
    if as_of is None:
        as_of = latest_day(tagged, day)
    anchor = as_of if isinstance(as_of, Column) else F.lit(as_of)
    rows = _tag_rows(tagged.where(F.col(day) <= anchor), key, tag)
    counts = (
        rows.where(F.col("_tag").isNotNull())
        .groupBy("_tag")
        .agg(F.count(F.lit(1)).alias("_popularity"))
    )
    return _summarise(_rate(rows, counts, key), key)
