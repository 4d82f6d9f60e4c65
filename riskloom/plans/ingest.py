"""The daily batch: landed feeds to bronze, then the master table and its checks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.plans.incremental import read_master, update_master
from riskloom.plans.silver import build_silver, validate_master, validate_rows
from riskloom.schemas import EPSS_BRONZE, KEV_BRONZE, NVD_BRONZE
from riskloom.sources import bronze, landing
from riskloom.sources.versioned import latest_version

SOURCES = ("nvd", "epss", "kev")


@dataclass(frozen=True)
class IngestResult:
    """Days and flags of one run; ``None`` where a step was left out."""

    nvd_since: date | None = None
    epss_day: date | None = None
    kev: bool = False
    silver: bool = False
    passed: bool | None = None
    epss_fallback: bool = False


def _land_epss(spark: SparkSession, landing_dir: str, bronze_dir: str, day: date) -> date:
    """Take the day before ``day``, or the one before that when it has not landed."""
    failure: Exception | None = None
    for back in (1, 2):
        wanted = day - timedelta(days=back)
        try:
            rows = landing.read_epss_csv(spark, f"{landing_dir}/epss/*{wanted.isoformat()}*", wanted)
            bronze.write_table(rows, f"{bronze_dir}/epss", EPSS_BRONZE, partition_by="snapshot_date")
            return wanted
        except (landing.FeedError, AnalysisException) as error:
            if isinstance(error, AnalysisException) and not bronze.is_absent(error):
                raise
            failure = error
    raise landing.FeedError(f"no score file for the two days before {day}") from failure


def _update_silver(spark: SparkSession, bronze_dir: str, root: str, landed: str | None) -> int:
    """Bring the versioned master table up to date with the bronze tables, of which the folder ``landed`` is new."""
    nvd = bronze.read_nvd_bronze(spark, f"{bronze_dir}/nvd")
    if latest_version(spark, root):
        new = bronze.read_or_none(spark, f"{bronze_dir}/nvd/{landed}", NVD_BRONZE) if landed else None
        # Of an id that landed, the row that counts may still be that of another folder.
        nvd = nvd.join(new.select("cve_id").distinct(), "cve_id", "left_semi") if new is not None else None
    history = bronze.read_or_none(spark, f"{bronze_dir}/epss")
    epss = bronze.latest_snapshot(history) if history is not None else None
    return update_master(spark, root, nvd, bronze.read_kev_bronze(spark, f"{bronze_dir}/kev"), epss)


def daily_ingest(
    spark: SparkSession,
    landing_dir: str,
    data_dir: str,
    target: date,
    *,
    nvd_since: date | None = None,
    nvd_lines: bool = False,
    sources: tuple[str, ...] = SOURCES,
    skip_silver: bool = False,
    incremental: bool = False,
) -> IngestResult:
    """One run; running it again for the same day replaces what it wrote.

    Page files of records and of the catalog are read by byte range, whatever their size; ``nvd_lines`` reads record files
    with one record a line instead. With ``incremental`` the master
    table is the versioned one under ``silver/cve_master_versions``, of which only buckets with changed ids are rewritten
    and which readers see as it was until the run has published it; else it is rebuilt in place.
    """
    bronze_dir, silver = f"{data_dir}/bronze", f"{data_dir}/silver/cve_master"
    since = epss_day = passed = None
    if "nvd" in sources:
        since = nvd_since or target - timedelta(days=365)
        rows = landing.read_nvd(spark, f"{landing_dir}/nvd/*{since.isoformat()}*.json", lines=nvd_lines, split_pages=True)
        # A folder per start date: later folders win when ids repeat.
        bronze.write_table(rows, f"{bronze_dir}/nvd/since={since.isoformat()}", NVD_BRONZE)
    if "kev" in sources:
        rows = landing.read_kev(spark, f"{landing_dir}/kev", split_pages=True)
        bronze.write_table(rows, f"{bronze_dir}/kev", KEV_BRONZE)
    if "epss" in sources:
        epss_day = _land_epss(spark, landing_dir, bronze_dir, target)
    ready = not skip_silver and all(
        bronze.read_or_none(spark, f"{bronze_dir}/{name}") is not None for name in ("nvd", "kev")
    )
    if ready:
        if incremental:
            silver = f"{data_dir}/silver/cve_master_versions"
            _update_silver(spark, bronze_dir, silver, f"since={since.isoformat()}" if since else None)
            summary = validate_rows(spark, read_master(spark, silver), silver, f"{data_dir}/validation")
        else:
            build_silver(spark, bronze_dir, silver)
            summary = validate_master(spark, silver, f"{data_dir}/validation")
        passed = summary.select(F.col("passed")).first()["passed"]
    fell_back = epss_day is not None and epss_day < target - timedelta(days=1)
    return IngestResult(since, epss_day, "kev" in sources, ready, passed, fell_back)
