"""Feature tables written from a stored master table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import tags, temporal
from riskloom.operators.tabular import tabular_frame


def _store(features: DataFrame, out: str) -> DataFrame:
    features.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return features.sparkSession.read.parquet(out)


def write_tabular_features(spark: SparkSession, silver: str, out: str) -> DataFrame:
    """Key, publication date and the tabular features."""
    return _store(tabular_frame(spark.read.parquet(silver)), out)


def write_temporal_features(spark: SparkSession, silver: str, as_of: date | None, out: str) -> DataFrame:
    """Key and the temporal features at ``as_of`` (default: the latest day)."""
    days = spark.read.parquet(silver).select("cve_id", "published_date")
    return _store(temporal.temporal_as_of(days, as_of).drop("published_date"), out)


def write_tag_features(spark: SparkSession, silver: str, out: str) -> DataFrame:
    """Key and the tag features over the whole table."""
    tagged = tags.explode_tags(
        spark.read.parquet(silver), key="cve_id", day="published_date", tags="cwe_ids"
    )
    return _store(tags.popularity_as_of(tagged, key="cve_id", day="published_date"), out)
