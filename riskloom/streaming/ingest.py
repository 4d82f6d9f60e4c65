"""Daily score files as a stream of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskloom.operators.dedup import keep_first
from riskloom.schemas import EPSS_BRONZE, conform
from riskloom.session import cut_lineage, kept
from riskloom.sources.bronze import read_or_none, write_table
from riskloom.sources.landing import EPSS_CSV, day_of_file

EPSS_LANDED = StructType(
    [
        *EPSS_BRONZE,
        StructField("landed_file", StringType()),
        StructField("landed_block", LongType()),
        StructField("landed_line", LongType()),
    ]
)


#: Rows of a day that one task sorts and writes.
PART_ROWS = 100_000


def _landed_rows(spark: SparkSession, landing_dir: str, files_per_batch: int) -> DataFrame:
    raw = (
        spark.readStream.schema(EPSS_CSV)
        .option("header", True)
        .option("comment", "#")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .csv(landing_dir)
    )
    return raw.select(
        F.col("cve").alias("cve_id"),
        F.col("epss").cast("float").alias("epss_score"),
        F.col("percentile").cast("float").alias("epss_percentile"),
        F.col("_metadata.file_path").alias("landed_file"),
        F.col("_metadata.file_block_start").alias("landed_block"),
    ).where(F.col("cve_id").isNotNull())


def score_file_stream(spark: SparkSession, landing_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of newly landed score files; the day comes from the file's path.

    The first three columns are read, whatever follows them; where they are not id, score and percentile the batch fails
    on the first score that is no number.
    """
    rows = _landed_rows(spark, landing_dir, files_per_batch)
    return rows.select(*EPSS_BRONZE.names[:3], day_of_file("landed_file").alias("snapshot_date"), "landed_file", "landed_block")


def ingest_scores(
    spark: SparkSession, landing_dir: str, bronze_path: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Write every file that has landed since the last run, then stop.

    Each batch is merged with the stored rows of the days it carries; of rows
    with one id and day the first file's, then the first line's, is kept. Rows
    are stored with the file they come from, and a file that is read again
    replaces its own rows, so a batch that is run again after a failure leaves
    the table as it was. A day may arrive in any number of files and runs.

    Rows are dealt once, by day and part of its ids, and are told apart and
    written where they lie; the days written replace the stored ones when all
    of them are written.
    """

    def merge_days(batch: DataFrame, _: int) -> None:
        # Lines are numbered as they are read, before anything is shuffled.
        with kept(batch.withColumn("landed_line", F.monotonically_increasing_id())) as lines:
            # The day is taken from the path once for each file; a batch has at most files_per_batch of them.
            counts = lines.groupBy("landed_file").agg(F.count(F.lit(1)).alias("_n"))
            files = cut_lineage(counts.withColumn("snapshot_date", day_of_file("landed_file")))
            rows = conform(lines.join(F.broadcast(files.drop("_n")), "landed_file"), EPSS_LANDED)
            if read_or_none(spark, bronze_path) is not None:
                # Rows of other writers name no file; they come first.
                old = spark.read.schema(EPSS_LANDED).parquet(bronze_path)
                old = old.join(files.select("snapshot_date").distinct(), "snapshot_date", "left_semi")
                old = old.join(files.select("landed_file"), "landed_file", "left_anti")
                rows = old.select(*EPSS_LANDED.names).unionByName(rows)
            # One number: the rows of the largest day.
            largest = files.groupBy("snapshot_date").agg(F.sum("_n").alias("_n")).agg(F.max("_n")).scalar()
            part = F.pmod(F.xxhash64("cve_id"), F.ceil(F.coalesce(largest, F.lit(1)) / PART_ROWS))
            dealt = rows.withColumn("_part", part).repartition("snapshot_date", "_part")
            first = keep_first(dealt, ["snapshot_date", "_part", "cve_id"], ["landed_file", "landed_block", "landed_line"])
            write_table(first, bronze_path, EPSS_LANDED, partition_by="snapshot_date", dealt=True)

    return (
        _landed_rows(spark, landing_dir, files_per_batch)
        .writeStream.foreachBatch(merge_days)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
