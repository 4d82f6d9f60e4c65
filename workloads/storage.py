"""Round trips through landed files and stored tables in the shared folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.dedup import keep_last
from riskloom.operators.ordering import slice_count
from riskloom.plans.features import write_tabular_features, write_tag_features, write_temporal_features
from riskloom.plans.incremental import read_master, update_master
from riskloom.schemas import EPSS_BRONZE, KEV_BRONZE, NVD_BRONZE
from riskloom.session import scratch_path
from riskloom.sources import bronze, buckets, landing
from riskloom.streaming.ingest import ingest_scores
from workloads import derived, flattening, joins
from workloads.features import _CALENDAR, _RATED_ALL, _TABULAR, _TAGGED, _counts, _plain, _summary
from workloads.flattening import nvd_records
from workloads.labels import SILVER_SQL, plain_master
from workloads.registry import query, table

# Scores dated by ship month, so that the number of daily files stays small at any scale.
_MONTHLY = f"""
monthly AS (
  SELECT cve_id, CAST(s AS FLOAT) AS epss_score, CAST(p AS FLOAT) AS epss_percentile, d AS snapshot_date FROM (
    SELECT {derived.LINE_ID} AS cve_id, l_discount AS s, l_tax AS p, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
      row_number() OVER (PARTITION BY l_orderkey, date_trunc('month', l_shipdate)
        ORDER BY l_discount DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn = 1)"""
_OUT = "cve_id, CAST(epss_score AS DOUBLE) AS epss_score, CAST(epss_percentile AS DOUBLE) AS epss_percentile, snapshot_date"


def monthly_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One score per id and month."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_discount").alias("epss_score"),
        F.col("l_tax").alias("epss_percentile"),
        F.to_date(F.date_trunc("month", F.col("l_shipdate"))).alias("snapshot_date"),
    )
    # Told apart by the number that the id is made of, which sorts faster than a text.
    one = keep_last(lines, ["l_orderkey", "snapshot_date"], ["epss_score", "epss_percentile"])
    return one.select(derived.cve("CVE-2024-", "l_orderkey").alias("cve_id"), "epss_score", "epss_percentile", "snapshot_date")


def _land(rows: DataFrame, path: str) -> str:
    """Write rows as landed score files, a folder per day."""
    named = rows.select(
        F.col("cve_id").alias("cve"),
        F.col("epss_score").alias("epss"),
        F.col("epss_percentile").alias("percentile"),
        "snapshot_date",
    ).hint("rebalance", "snapshot_date")
    writer = named.write.mode("append").partitionBy("snapshot_date")
    writer.option("header", True).option("compression", "gzip").csv(path)
    return path


def _as_double(df: DataFrame) -> DataFrame:
    return df.select(
        "cve_id",
        F.col("epss_score").cast("double").alias("epss_score"),
        F.col("epss_percentile").cast("double").alias("epss_percentile"),
        "snapshot_date",
    )


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly WHERE snapshot_date = DATE '1998-03-01'")
def csv_snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """One day's scores as gzipped CSV, read back, stored and pruned by partition."""
    base = scratch_path(spark, "scores")
    path = _land(monthly_scores(spark, folder), f"{base}/landing")
    day = date(1998, 3, 1)
    rows = landing.read_epss_csv(spark, f"{path}/snapshot_date={day.isoformat()}", day)
    bronze.write_table(rows, f"{base}/epss", EPSS_BRONZE, partition_by="snapshot_date")
    return _as_double(bronze.epss_snapshot(bronze.read_epss_history(spark, f"{base}/epss"), day))


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly")
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All days through the file stream in two runs; the second picks up what landed since."""
    base = scratch_path(spark, "stream")
    staged = f"{base}/staged"
    bronze.write_table(monthly_scores(spark, folder), staged, EPSS_BRONZE)
    rows = spark.read.parquet(staged)
    split = F.col("snapshot_date") < F.lit(date(1998, 1, 1))
    for part in (rows.where(split), rows.where(~split)):
        _land(part, f"{base}/landing")
        ingest_scores(spark, f"{base}/landing", f"{base}/epss", f"{base}/checkpoint").awaitTermination()
    return _as_double(bronze.read_epss_history(spark, f"{base}/epss"))


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly")
def incremental_same_day(spark: SparkSession, folder: str) -> DataFrame:
    """Every day in several files that land over two runs, and some rows of the first run again in the second."""
    base = scratch_path(spark, "same-day")
    staged = f"{base}/staged"
    bronze.write_table(monthly_scores(spark, folder), staged, EPSS_BRONZE)
    rows = spark.read.parquet(staged)
    part = F.pmod(F.xxhash64("cve_id"), F.lit(4))
    for low, high in ((0, 1), (1, 3)):
        _land(rows.where(part.between(low, high)), f"{base}/landing")
        ingest_scores(spark, f"{base}/landing", f"{base}/epss", f"{base}/checkpoint").awaitTermination()
    return _as_double(bronze.read_epss_history(spark, f"{base}/epss"))


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly WHERE snapshot_date = (SELECT max(snapshot_date) FROM monthly)")
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest day of a stored history."""
    return _as_double(bronze.latest_snapshot(_stored_history(spark, folder)))


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly WHERE snapshot_date = DATE '1999-05-01'")
def chosen_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A requested day that has landed."""
    return _as_double(bronze.chosen_snapshot(_stored_history(spark, folder), date(1999, 5, 1)))


@query(f"WITH {_MONTHLY} SELECT {_OUT} FROM monthly WHERE snapshot_date = (SELECT max(snapshot_date) FROM monthly)")
def chosen_snapshot_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A requested day that has not landed: the newest is taken."""
    return _as_double(bronze.chosen_snapshot(_stored_history(spark, folder), date(1999, 5, 2)))


def _stored_history(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "history")
    bronze.write_table(monthly_scores(spark, folder), path, EPSS_BRONZE, partition_by="snapshot_date")
    return bronze.read_epss_history(spark, path)


def land_pages(records: DataFrame, path: str, pages: int) -> str:
    """Write records (``_pos``, ``_json``) as that many page files, each one JSON object over many lines."""
    page = F.pmod(F.col("_pos"), F.lit(pages)).alias("page")
    first = F.min("_pos").alias("_first")
    body = records.select(page, F.col("_pos").alias("_line"), F.concat(F.lit(","), "_json").alias("value"), F.lit(1).alias("_part"))
    opening = F.lit('{"format": "a \\"vulnerabilities\\": [{ b", "more": {"a": [{"b": [1, "}"]}, 3]}, "vulnerabilities" : [ "none"')
    ends = records.groupBy(page).agg(first).select("page", F.explode(F.array(F.lit(0), F.lit(2))).alias("_part"))
    frame = ends.select(
        "page", F.lit(0).cast("long").alias("_line"), F.when(F.col("_part") == 0, opening).otherwise('], "others": [{"cve": {"id": "CVE-1999-1"}}]}').alias("value"), "_part"
    )
    rows = body.unionByName(frame).repartition(pages, "page").sortWithinPartitions("page", "_part", "_line")
    rows.select("page", "value").write.partitionBy("page").text(path)
    return path


@query(flattening.NVD_FLAT)
def nvd_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Records out of large page files that are read by byte range."""
    path = land_pages(nvd_records(spark, folder), scratch_path(spark, "pages"), 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        rows = landing.read_nvd(spark, path, split_pages=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return flattening.joined_lists(rows)


@query(joins.AS_OF_SQL)
def asof_bucketed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score known at publication, from a history stored in buckets by id in two runs."""
    path = scratch_path(spark, "buckets")
    rows = derived.history(spark, folder)
    early = F.col("snapshot_date") < F.lit(date(1996, 1, 1))
    for part in (rows.where(early), rows.where(~early)):
        buckets.store_history(part, path, buckets=max(8, slice_count(rows)))
    return joins.scores_as_of(derived.nvd(spark, folder), buckets.read_history(spark, path), right_unique=True)


@query(SILVER_SQL)
def incremental_master(spark: SparkSession, folder: str) -> DataFrame:
    """The master table published twice: first with stale rows, an older catalog and older scores, then by what changed."""
    root = scratch_path(spark, "master")
    nvd, kev, history = derived.nvd(spark, folder), derived.kev(spark, folder), derived.history(spark, folder)
    stale = F.col("ref_has_exploit") & (F.col("vendor_count") == 0)
    before = nvd.withColumn("description_len", F.when(stale, 1).otherwise(F.col("description_len")))
    known = before.where(~stale | (F.col("product_count") > 0))
    old_scores = history.where(F.col("snapshot_date") < F.lit(date(1998, 1, 1)))
    update_master(spark, root, known, kev.where(F.col("date_added") < F.lit(date(1994, 1, 1))), old_scores, buckets=32)
    update_master(spark, root, nvd.where(stale), kev, history)
    return plain_master(read_master(spark, root))


@query(
    f"""SELECT {derived.cve_sql("CVE-2023-", "p_partkey")} AS cve_id,
      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END || CASE WHEN p_partkey % 2 = 0 THEN ' (revised)' ELSE '' END
        AS description
    FROM part WHERE p_partkey % 50 <> 49"""
)
def bronze_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    """Two stored batches that overlap: of rows with one id the later batch's wins."""
    base = scratch_path(spark, "nvd")
    rows = landing.nvd_rows(nvd_records(spark, folder), order=("_pos",))
    bronze.write_table(rows, f"{base}/since=2020-01-01", NVD_BRONZE)
    revised = rows.where(F.substring("cve_id", -1, 1).isin("0", "2", "4", "6", "8")).withColumn(
        "description", F.concat("description", F.lit(" (revised)"))
    )
    bronze.write_table(revised, f"{base}/since=2021-01-01", NVD_BRONZE)
    return bronze.read_nvd_bronze(spark, base).select("cve_id", "description")


@query(
    f"""WITH {derived.KEV} SELECT cve_id, min(date_added) AS date_added FROM kev GROUP BY cve_id"""
)
def kev_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries flattened, stored and read back."""
    path = scratch_path(spark, "kev")
    entries = derived.kev(spark, folder).select(
        "date_added",
        F.to_json(
            F.struct(F.col("cve_id").alias("cveID"), F.col("date_added").cast("string").alias("dateAdded"))
        ).alias("_json"),
    )
    bronze.write_table(landing.kev_rows(entries, order=("date_added",)), path, KEV_BRONZE)
    return bronze.read_kev_bronze(spark, path).select("cve_id", "date_added")


@query(
    f"""WITH {derived.NVD}, {_TAGGED}, {_RATED_ALL}, graph AS ({_summary("cve_id")}),
    dated AS (SELECT cve_id, published_date AS d FROM nvd),
    times AS (SELECT cve_id, {_CALENDAR}, CAST((SELECT max(d) FROM dated) - d AS INTEGER) AS f_age_days, {_counts()}
      FROM dated)
    SELECT nvd.cve_id, nvd.published_date, {_TABULAR}, times.* EXCLUDE (cve_id), graph.* EXCLUDE (cve_id)
    FROM nvd JOIN times ON times.cve_id = nvd.cve_id JOIN graph ON graph.cve_id = nvd.cve_id"""
)
def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    """Tabular, temporal and tag features, each written to its own table and read back."""
    base = scratch_path(spark, "features")
    derived.nvd(spark, folder).write.parquet(f"{base}/master")
    made = write_tabular_features(spark, f"{base}/master", f"{base}/tabular")
    for other in (
        write_temporal_features(spark, f"{base}/master", None, f"{base}/temporal"),
        write_tag_features(spark, f"{base}/master", f"{base}/tags"),
    ):
        made = made.join(other, "cve_id")
    return _plain(made)
