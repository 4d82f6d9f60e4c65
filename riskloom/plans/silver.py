"""Bronze tables to the labelled master table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators.dedup import keep_last
from riskloom.operators.labels import HORIZON_DAYS, label_within_horizon
from riskloom.operators.quality import master_rules, roll_up, validate
from riskloom.schemas import CVE_MASTER, conform
from riskloom.sources import bronze

FROM_NVD = CVE_MASTER.names[:12]


def newest_scores(epss: DataFrame, *, hashed: bool = False) -> DataFrame:
    """One row per id; between rows of one day the larger score counts. ``hashed`` as in ``keep_first``."""
    return keep_last(epss, ["cve_id"], ["snapshot_date", "epss_score", "epss_percentile"], hashed=hashed)


def build_master(
    nvd: DataFrame,
    kev: DataFrame,
    epss: DataFrame | None,
    *,
    horizon_days: int = HORIZON_DAYS,
    unique: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Join, label and order the columns of the contract, followed by the columns of ``nvd`` in ``keep``.

    ``epss`` is one snapshot; without it the score columns are typed nulls. ``unique`` says that ``kev`` and ``epss`` hold
    an id once. Both joins are on the id, so the vulnerability rows shuffle at most once.
    """
    base = nvd.select(*FROM_NVD, *keep)
    if epss is not None:
        newest = epss if unique else newest_scores(epss)
        base = base.join(newest.withColumnRenamed("snapshot_date", "epss_snapshot_date"), "cve_id", "left")
    else:
        for name in ("epss_score", "epss_percentile", "epss_snapshot_date"):
            base = base.withColumn(name, F.lit(None).cast(CVE_MASTER[name].dataType))
    labelled = label_within_horizon(base, kev, horizon_days=horizon_days, marks_unique=unique)
    return conform(labelled, StructType([*CVE_MASTER, *(labelled.schema[name] for name in keep)]))


def build_silver(
    spark: SparkSession,
    bronze_dir: str,
    silver_path: str,
    *,
    snapshot: date | None = None,
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """Read bronze, write the master table and return it as stored."""
    nvd = bronze.read_nvd_bronze(spark, f"{bronze_dir}/nvd")
    kev = bronze.read_kev_bronze(spark, f"{bronze_dir}/kev")
    history = bronze.read_or_none(spark, f"{bronze_dir}/epss")
    epss = bronze.chosen_snapshot(history, snapshot) if history is not None else None
    master = build_master(nvd, kev, epss, horizon_days=horizon_days)
    # Date order within each file is enough for pruning by file statistics.
    bronze.write_table(master.sortWithinPartitions("published_date"), silver_path, CVE_MASTER)
    return spark.read.parquet(silver_path)


def validate_master(spark: SparkSession, silver_path: str, result_path: str | None = None) -> DataFrame:
    """Summary of all checks on the stored master table, optionally written as JSON."""
    return validate_rows(spark, bronze.read_or_none(spark, silver_path), silver_path, result_path)


def validate_rows(spark: SparkSession, table: DataFrame | None, name: str, result_path: str | None = None) -> DataFrame:
    """The same on rows at hand; without any table the check is that it is missing."""
    if table is None:
        results = spark.createDataFrame(
            [("present", 0, 1, False, f"missing table: {name}")],
            "check string, n_rows bigint, n_bad bigint, passed boolean, detail string",
        )
    else:
        results = validate(table, CVE_MASTER, master_rules())
    summary = roll_up(results, name)
    if result_path:
        summary.write.mode("overwrite").json(result_path)
    return summary
