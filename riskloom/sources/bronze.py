"""Stored bronze tables: contract writers and scans."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from riskloom.operators.dedup import keep_last
from riskloom.schemas import EPSS_BRONZE, NVD_BRONZE, conform


def write_table(df: DataFrame, path: str, contract: StructType, partition_by: str | None = None, *, dealt: bool = False) -> None:
    """Cast to the contract and overwrite; with a partition column only its values present in ``df``.

    Rows are rebalanced by the partition column first, unless they are ``dealt`` already: a value goes to few
    tasks and so to few files, and adaptive execution splits a value that is too large.
    """
    rows = conform(df, contract)
    if partition_by and not dealt:
        rows = rows.hint("rebalance", partition_by)
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def is_absent(error: AnalysisException) -> bool:
    """Whether a read failed because there is no path or no file in it."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# Parquet values of the narrow type can be read as the wide one.
_WIDER = {"int": LongType(), "float": DoubleType()}


def read_or_none(spark: SparkSession, path: str, contract: StructType | None = None) -> DataFrame | None:
    """The table, or ``None`` when the path is absent or empty; whatever else goes wrong is raised.

    With a ``contract`` its columns are read, whichever of them a file has, and
    numbers as the wide type, so that files with narrow and wide ones fit together.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if is_absent(error):
            return None
        raise
    if contract is None:
        return table
    extra = [field for field in table.schema if field.name not in contract.names]
    wide = [StructField(f.name, _WIDER.get(f.dataType.simpleString(), f.dataType)) for f in contract]
    return spark.read.schema(StructType([*wide, *extra])).parquet(path)


def read_nvd_bronze(spark: SparkSession, path: str) -> DataFrame:
    """All vulnerability files; of rows with one id the last file's wins."""
    files = read_or_none(spark, path, NVD_BRONZE)
    if files is None:
        raise FileNotFoundError(f"no vulnerability tables under {path}")
    # A write holds an id once, so the path alone decides.
    named = files.select("*", F.col("_metadata.file_path").alias("_file"))
    return conform(keep_last(named, ["cve_id"], ["_file"]), NVD_BRONZE)


def read_kev_bronze(spark: SparkSession, path: str) -> DataFrame:
    """The exploit catalog table."""
    table = read_or_none(spark, path)
    if table is None:
        raise FileNotFoundError(f"no exploit catalog at {path}")
    return table


def read_epss_history(spark: SparkSession, path: str) -> DataFrame:
    """All daily scores; a typed empty table when nothing has landed."""
    table = read_or_none(spark, path)
    if table is None:
        return spark.createDataFrame([], EPSS_BRONZE)
    return conform(table, EPSS_BRONZE)


def epss_snapshot(history: DataFrame, day: date) -> DataFrame:
    """Scores of exactly one day; prunes partitions when read from the table."""
    return history.where(F.col("snapshot_date") == F.lit(day))


def latest_snapshot(history: DataFrame) -> DataFrame:
    """Scores of the newest day, found by a scalar subquery."""
    return history.where(F.col("snapshot_date") == history.agg(F.max("snapshot_date")).scalar())


def chosen_snapshot(history: DataFrame, requested: date | None = None) -> DataFrame:
    """The requested day when it has landed, else the newest."""
    if requested is None:
        return latest_snapshot(history)
    wanted = F.when(F.col("snapshot_date") == F.lit(requested), F.lit(requested))
    day = history.agg(F.coalesce(F.max(wanted), F.max("snapshot_date"))).scalar()
    return history.where(F.col("snapshot_date") == day)


def baseline_from_snapshot(table: DataFrame) -> DataFrame:
    """Baseline columns of a snapshot in bronze or in feed naming; unreadable scores drop out."""
    score = "epss_score" if "epss_score" in table.columns else "epss"
    percentile = "epss_percentile" if "epss_percentile" in table.columns else "percentile"
    return table.select(
        (F.col("cve_id") if "cve_id" in table.columns else F.col("cve")).alias("cve_id"),
        F.col(score).try_cast("double").alias("epss_score"),
        F.coalesce(F.col(percentile).try_cast("double"), F.lit(0.0)).alias("epss_percentile"),
    ).where(F.col("epss_score").isNotNull())
