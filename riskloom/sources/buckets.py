"""Score histories stored in buckets of the id, so that joins on the id leave them where they are.

A history is a Parquet table clustered by id and sorted by id and day. Spark's planner reads each bucket as one partition of
a join or grouping on the id; only the other side is shuffled, into as many partitions. Days that land later are added as
further files of the same buckets. What makes a folder a bucketed table lies beside it as a small JSON file, so that any
session can open it.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.schemas import EPSS_BRONZE, conform
from riskloom.sources.files import exists, read_text, write_text

BUCKETS = 200


def _table_name(path: str) -> str:
    return f"bucketed_{sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def _facts_path(path: str) -> str:
    return f"{path.rstrip('/')}.buckets.json"


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed table stored under ``path``, known to this session from now on."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        facts = json.loads(read_text(spark, _facts_path(path)))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(facts["schema"]))
        keys, order = (", ".join(f"`{k}`" for k in facts[what]) for what in ("keys", "sort"))
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({order}) "
            f"INTO {facts['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def append_bucketed(df: DataFrame, path: str, *, keys: list[str], sort: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add rows to the bucketed table under ``path``, which is made if there is none, and return the whole table.

    Rows are dealt by the same hash as the buckets first, so that a write adds one file to each bucket that gets rows. An
    existing table keeps its keys and number of buckets; columns are taken by name.
    """
    spark = df.sparkSession
    if not exists(spark, _facts_path(path)):
        facts = {"keys": keys, "sort": sort, "buckets": buckets, "schema": df.schema.jsonValue()}
        write_text(spark, _facts_path(path), json.dumps(facts))
    facts = json.loads(read_text(spark, _facts_path(path)))
    own, count = facts["keys"], facts["buckets"]
    dealt = df.select(*StructType.fromJson(facts["schema"]).names).repartition(count, *own)
    writer = dealt.write.mode("append").format("parquet").option("compression", "zstd").option("path", path)
    name = _table_name(path)
    if exists(spark, path):
        open_bucketed(spark, path)
    writer.bucketBy(count, own).sortBy(facts["sort"]).saveAsTable(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def store_history(rows: DataFrame, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Add daily scores to the bucketed history under ``path``: of rows with one id and day that land together one is kept.

    The larger score counts, then the larger percentile. Days that are in the history already must not land again; the
    day-partitioned bronze table is where a day can be replaced.
    """
    ranked = conform(rows, EPSS_BRONZE).where("cve_id is not null and snapshot_date is not null")
    best = ranked.groupBy("cve_id", "snapshot_date").agg(F.max(F.struct("epss_score", "epss_percentile")).alias("_b"))
    one = best.select("cve_id", "_b.epss_score", "_b.epss_percentile", "snapshot_date")
    return append_bucketed(one, path, keys=["cve_id"], sort=["cve_id", "snapshot_date"], buckets=buckets)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed history under ``path``."""
    return open_bucketed(spark, path)
