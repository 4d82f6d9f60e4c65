"""Vulnerability tables derived from the supplied ones, as DataFrames and as SQL.

An order stands for a vulnerability, its returned lines for exploit-catalog
entries, and every line for one daily score. Each function has a CTE of the
same name that yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.silver import build_master
from workloads.registry import table


def cve(prefix: str, number: str) -> Column:
    """An id from a key column."""
    return F.concat(F.lit(prefix), F.lpad(F.col(number).cast("string"), 12, "0"))


def cve_sql(prefix: str, number: str) -> str:
    """The same id in SQL."""
    return f"'{prefix}' || lpad(CAST({number} AS VARCHAR), 12, '0')"


ORDER_ID = cve_sql("CVE-2024-", "o_orderkey")
LINE_ID = cve_sql("CVE-2024-", "l_orderkey")


def nvd(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as flat vulnerability rows."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    tag_a = F.concat(F.lit("CWE-"), (cust % 13).cast("string"))
    tag_b = F.concat(F.lit("CWE-"), (key % 11).cast("string"))
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL")
        .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
        .when(F.col("o_orderpriority") == "5-LOW", "LOW")
    )
    vector = F.when(F.col("o_orderstatus") == "F", "CVSS:3.1/AV:N/AC:L").when(
        F.col("o_orderstatus") == "O", "CVSS:3.1/AV:L/AC:L"
    )
    return table(spark, folder, "orders").select(
        cve("CVE-2024-", "o_orderkey").alias("cve_id"),
        day.alias("published_date"),
        F.date_add(day, (cust % 20).cast("int")).alias("last_modified_date"),
        F.when(
            F.col("o_orderpriority") != "5-LOW", ((key % 101).cast("double") / 10).cast("float")
        ).alias("cvss_v3_base_score"),
        severity.alias("cvss_v3_severity"),
        vector.alias("cvss_v3_vector"),
        F.when(cust % 7 != 0, F.array_sort(F.array_distinct(F.array(tag_a, tag_b)))).alias("cwe_ids"),
        (key % 3).cast("int").alias("vendor_count"),
        (key % 5).cast("int").alias("product_count"),
        (F.length("o_orderpriority") * 10).alias("description_len"),
        (F.col("o_orderstatus") == "F").alias("ref_has_exploit"),
        (key % 2 == 0).alias("ref_has_patch"),
    )


NVD = f"""nvd AS (
  SELECT {ORDER_ID} AS cve_id,
    CAST(o_orderdate AS DATE) AS published_date,
    CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 AS INTEGER) AS last_modified_date,
    CASE WHEN o_orderpriority <> '5-LOW'
         THEN CAST(CAST(o_orderkey % 101 AS DOUBLE) / 10 AS FLOAT) END AS cvss_v3_base_score,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
         WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END AS cvss_v3_severity,
    CASE o_orderstatus WHEN 'F' THEN 'CVSS:3.1/AV:N/AC:L' WHEN 'O' THEN 'CVSS:3.1/AV:L/AC:L' END
      AS cvss_v3_vector,
    CASE WHEN o_custkey % 7 <> 0 THEN list_sort(list_distinct(
      ['CWE-' || CAST(o_custkey % 13 AS VARCHAR), 'CWE-' || CAST(o_orderkey % 11 AS VARCHAR)])) END
      AS cwe_ids,
    CAST(o_orderkey % 3 AS INTEGER) AS vendor_count,
    CAST(o_orderkey % 5 AS INTEGER) AS product_count,
    CAST(length(o_orderpriority) * 10 AS INTEGER) AS description_len,
    o_orderstatus = 'F' AS ref_has_exploit,
    o_orderkey % 2 = 0 AS ref_has_patch
  FROM orders)"""


def kev(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines as catalog entries; an order may have several."""
    return table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        cve("CVE-2024-", "l_orderkey").alias("cve_id"), F.to_date("l_shipdate").alias("date_added")
    )


KEV = f"""kev AS (
  SELECT {LINE_ID} AS cve_id, CAST(l_shipdate AS DATE) AS date_added
  FROM lineitem WHERE l_returnflag = 'R')"""


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as daily scores, dated 60 days before shipment."""
    return table(spark, folder, "lineitem").select(
        cve("CVE-2024-", "l_orderkey").alias("cve_id"),
        (F.col("l_discount") * 10).cast("float").alias("epss_score"),
        (F.col("l_tax") * 10).cast("float").alias("epss_percentile"),
        F.date_sub(F.to_date("l_shipdate"), 60).alias("snapshot_date"),
    )


HISTORY = f"""history AS (
  SELECT {LINE_ID} AS cve_id,
    CAST(l_discount * 10 AS FLOAT) AS epss_score,
    CAST(l_tax * 10 AS FLOAT) AS epss_percentile,
    CAST(l_shipdate AS DATE) - 60 AS snapshot_date
  FROM lineitem)"""


def master(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled master table over the three."""
    return build_master(nvd(spark, folder), kev(spark, folder), history(spark, folder))


MASTER = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id
    ORDER BY snapshot_date DESC, epss_score DESC, epss_percentile DESC) AS rn FROM history) WHERE rn = 1),
first_mark AS (SELECT cve_id, min(date_added) AS kev_date_added FROM kev GROUP BY cve_id),
master AS (
  SELECT nvd.*, latest.epss_score, latest.epss_percentile, latest.snapshot_date AS epss_snapshot_date,
    first_mark.kev_date_added IS NOT NULL AS in_kev, first_mark.kev_date_added,
    coalesce(first_mark.kev_date_added <= nvd.published_date + 30, FALSE) AS exploited_30d
  FROM nvd LEFT JOIN latest ON nvd.cve_id = latest.cve_id
           LEFT JOIN first_mark ON nvd.cve_id = first_mark.cve_id)"""

WITH_MASTER = f"WITH {NVD}, {KEV}, {HISTORY}, {MASTER}"
