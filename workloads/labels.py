"""Labels, censoring, the master table and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.dedup import distinct_keys, keep_first, keep_last
from riskloom.operators.labels import closed, drop_open_rows, label_within_horizon
from riskloom.operators.temporal import latest_day
from riskloom.operators.union import union_relaxed
from workloads import derived
from workloads.registry import query, table


@query(
    """
    SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS order_date, f.first_ship,
           f.first_ship IS NOT NULL AS shipped,
           coalesce(f.first_ship <= CAST(o.o_orderdate AS DATE) + 30, FALSE) AS within_30d
    FROM orders o LEFT JOIN (
      SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship FROM lineitem GROUP BY l_orderkey
    ) f ON f.l_orderkey = o.o_orderkey
    """
)
def label_within_30d(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose first shipment falls within 30 days."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    ships = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("ship_date")
    )
    return label_within_horizon(
        orders,
        ships,
        key="o_orderkey",
        start="order_date",
        mark_date="ship_date",
        date_as="first_ship",
        flag_as="shipped",
        label_as="within_30d",
    )


@query(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders
    WHERE CAST(o_orderdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 30
    """
)
def right_censor(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose 30-day window has closed by the latest order date."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return drop_open_rows(orders, latest_day(orders, "order_date"), start="order_date")


@query(
    """
    SELECT CAST(o_orderdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 30 AS closed,
           count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
    FROM orders GROUP BY 1
    """
)
def censor_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts and date ranges on both sides of the censoring date."""
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))
    flag = closed(F.col("d"), latest_day(orders, "d"))
    return orders.groupBy(flag.alias("closed")).agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
    )


SILVER_SQL = (
    derived.WITH_MASTER
    + """
    SELECT cve_id, published_date, last_modified_date, CAST(cvss_v3_base_score AS DOUBLE) AS cvss_v3_base_score,
      cvss_v3_severity, cvss_v3_vector, array_to_string(cwe_ids, '|') AS cwe_ids, vendor_count, product_count,
      description_len, ref_has_exploit, ref_has_patch, CAST(epss_score AS DOUBLE) AS epss_score,
      CAST(epss_percentile AS DOUBLE) AS epss_percentile, epss_snapshot_date, in_kev, kev_date_added, exploited_30d
    FROM master
    """
)


@query(SILVER_SQL)
def silver_build(spark: SparkSession, folder: str) -> DataFrame:
    """The master table: latest score, first catalog entry and label per vulnerability."""
    return plain_master(derived.master(spark, folder))


def plain_master(master: DataFrame) -> DataFrame:
    """The master table in types that both engines print alike."""
    made = master.withColumn("cwe_ids", F.array_join("cwe_ids", "|"))
    for name in ("cvss_v3_base_score", "epss_score", "epss_percentile"):
        made = made.withColumn(name, F.col(name).cast("double"))
    return made


@query(
    f"""
    WITH {derived.NVD}, {derived.KEV}
    SELECT nvd.cve_id, published_date, CAST(NULL AS DOUBLE) AS epss_score, CAST(NULL AS DATE) AS epss_snapshot_date,
      m.d IS NOT NULL AS in_kev, m.d AS kev_date_added, coalesce(m.d <= published_date + 60, FALSE) AS exploited
    FROM nvd LEFT JOIN (SELECT cve_id, min(date_added) AS d FROM kev GROUP BY cve_id) m ON m.cve_id = nvd.cve_id
    """
)
def silver_without_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The master table with no score snapshot and a 60-day horizon."""
    made = derived.build_master(
        derived.nvd(spark, folder), derived.kev(spark, folder), None, horizon_days=60
    )
    return made.select(
        "cve_id",
        "published_date",
        F.col("epss_score").cast("double").alias("epss_score"),
        "epss_snapshot_date",
        "in_kev",
        "kev_date_added",
        F.col("exploited_30d").alias("exploited"),
    )


_PICK = """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {way}, event_id {way}) AS rn FROM events
    ) WHERE rn = 1
"""


@query(_PICK.format(way="ASC"))
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's first event."""
    return keep_first(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query(_PICK.format(way="DESC"))
def dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last event."""
    return keep_last(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_date FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem
    ) WHERE rn = 1
    """
)
def dedup_composite_key(spark: SparkSession, folder: str) -> DataFrame:
    """One line per (order, line number), the earliest shipped."""
    lines = table(spark, folder, "lineitem")
    first = keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return first.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_date")
    )


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (user, event type) pairs."""
    return distinct_keys(table(spark, folder, "events"), ["user_id", "event_type"])


@query(
    """
    SELECT 'part' AS source, CAST(p_partkey AS BIGINT) AS key, CAST(p_size AS DOUBLE) AS amount FROM part
    UNION ALL SELECT 'line', CAST(l_linenumber AS BIGINT), l_quantity FROM lineitem
    """
)
def union_of_types(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables below each other, int with bigint and int with double."""
    parts = table(spark, folder, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("key"), F.col("p_size").alias("amount")
    )
    lines = table(spark, folder, "lineitem").select(
        F.lit("line").alias("source"), F.col("l_linenumber").alias("key"), F.col("l_quantity").alias("amount")
    )
    return union_relaxed([parts, lines])
