"""Tabular, temporal and tag features, and the assembled frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import tags, temporal
from riskloom.operators.assemble import BASE, feature_frame
from riskloom.operators.tabular import tabular_frame
from workloads import derived
from workloads.joins import _AS_OF
from workloads.registry import query, table

_TABULAR = """
  CAST(coalesce(cvss_v3_base_score, 0) AS DOUBLE) AS f_cvss_v3_base_score,
  CASE cvss_v3_severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4
    ELSE 0 END AS f_cvss_v3_severity_rank,
  CAST(coalesce(contains(cvss_v3_vector, 'AV:N'), FALSE) AS INTEGER) AS f_cvss_av_network,
  CAST(coalesce(contains(cvss_v3_vector, 'Au:N'), FALSE) AS INTEGER) AS f_cvss_au_none,
  CAST(coalesce(len(cwe_ids), 0) AS INTEGER) AS f_cwe_count,
  vendor_count AS f_vendor_count, product_count AS f_product_count, description_len AS f_description_len,
  CAST(ref_has_exploit AS INTEGER) AS f_ref_has_exploit, CAST(ref_has_patch AS INTEGER) AS f_ref_has_patch"""


def _plain(df: DataFrame) -> DataFrame:
    """Byte features as int and float features as double, for comparison."""
    wider = {"tinyint": "int", "float": "double"}
    return df.select([F.col(n).cast(wider.get(t, t)).alias(n) for n, t in df.dtypes])


@query(f"WITH {derived.NVD} SELECT cve_id, published_date, {_TABULAR} FROM nvd")
def tabular_features(spark: SparkSession, folder: str) -> DataFrame:
    """The ten per-row features."""
    return _plain(tabular_frame(derived.nvd(spark, folder)))


_CALENDAR = """
  CAST(year(d) AS INTEGER) AS f_cve_year, CAST(month(d) AS INTEGER) AS f_cve_month,
  CAST(isodow(d) AS INTEGER) AS f_cve_weekday"""
_ORDER_DAYS = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"
_WEEK = "PARTITION BY year(d), week(d)"
_MONTH = "PARTITION BY year(d), month(d)"
_UPTO = " ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _counts(extra: str = "") -> str:
    return (
        f"CAST(count(*) OVER ({_WEEK}{extra}) AS INTEGER) AS f_cves_published_same_week, "
        f"CAST(count(*) OVER ({_MONTH}{extra}) AS INTEGER) AS f_cves_published_same_month"
    )


def _order_days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query(f"WITH {_ORDER_DAYS} SELECT o_orderkey, d, {_CALENDAR}, 0 AS f_age_days, {_counts(_UPTO)} FROM o")
def temporal_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar parts and counts up to and including each order's own day."""
    return temporal.temporal_per_row(_order_days(spark, folder), day="d")


@query(
    f"WITH {_ORDER_DAYS} SELECT o_orderkey, d, {_CALENDAR}, "
    f"CAST((SELECT max(d) FROM o) - d AS INTEGER) AS f_age_days, {_counts()} FROM o"
)
def temporal_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The same as of the latest day."""
    return temporal.temporal_as_of(_order_days(spark, folder), day="d")


@query(
    f"WITH {_ORDER_DAYS} SELECT o_orderkey, d, {_CALENDAR}, "
    f"CAST(DATE '1999-06-15' - d AS INTEGER) AS f_age_days, {_counts()} FROM o WHERE d <= DATE '1999-06-15'"
)
def temporal_as_of_day(spark: SparkSession, folder: str) -> DataFrame:
    """The same as of 1999-06-15: later orders are not seen."""
    anchor = F.lit("1999-06-15").cast("date")
    return temporal.temporal_as_of(_order_days(spark, folder), anchor, day="d")


@query(
    f"""
    WITH {_ORDER_DAYS} SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY isoyear(d), week(d){_UPTO}) AS INTEGER)
      AS f_cves_published_same_week FROM o
    """
)
def temporal_iso_year(spark: SparkSession, folder: str) -> DataFrame:
    """Same-week counts with ISO years, so that a week is never split or merged at New Year."""
    made = temporal.temporal_per_row(_order_days(spark, folder), day="d", iso_year=True)
    return made.select("o_orderkey", "f_cves_published_same_week")


def _summary(key: str) -> str:
    return f"""
    SELECT {key}, CAST(max(coalesce(pop, 0)) AS INTEGER) AS f_max_cwe_popularity,
      CAST(CAST(avg(coalesce(pop, 0)) AS FLOAT) AS DOUBLE) AS f_mean_cwe_popularity,
      CAST(count(DISTINCT tag) AS INTEGER) AS f_cwe_distinct_count
    FROM rated GROUP BY {key}"""


_TAGGED = """
tagged AS (
  SELECT cve_id, published_date AS d, unnest(cwe_ids) AS tag FROM nvd WHERE cwe_ids IS NOT NULL
  UNION ALL SELECT cve_id, published_date, NULL FROM nvd WHERE cwe_ids IS NULL)"""
_RATED_UPTO = """
daily AS (SELECT tag, d, count(*) AS n FROM tagged WHERE tag IS NOT NULL GROUP BY tag, d),
upto AS (SELECT tag, d, sum(n) OVER (PARTITION BY tag ORDER BY d) AS pop FROM daily),
rated AS (SELECT t.*, u.pop FROM tagged t LEFT JOIN upto u ON u.tag = t.tag AND u.d = t.d)"""
_RATED_ALL = """
total AS (SELECT tag, count(*) AS pop FROM tagged WHERE tag IS NOT NULL GROUP BY tag),
rated AS (SELECT t.*, u.pop FROM tagged t LEFT JOIN total u ON u.tag = t.tag)"""


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    return tags.explode_tags(
        derived.nvd(spark, folder), key="cve_id", day="published_date", tags="cwe_ids"
    )


@query(f"WITH {derived.NVD}, {_TAGGED}, {_RATED_UPTO} {_summary('cve_id')}")
def tag_popularity_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Popularity of each row's tags, counting rows up to its own day."""
    return _plain(tags.popularity_per_row(_tagged(spark, folder), key="cve_id", day="published_date"))


@query(f"WITH {derived.NVD}, {_TAGGED}, {_RATED_ALL} {_summary('cve_id')}")
def tag_popularity_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Popularity over all rows."""
    return _plain(tags.popularity_as_of(_tagged(spark, folder), key="cve_id", day="published_date"))


_BRANDS = """
tagged AS (
  SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS d, p_brand AS tag
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""


@query(f"WITH {_BRANDS}, {_RATED_UPTO} {_summary('o_orderkey')}")
def brand_popularity_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Popularity of the brands in each order, counting orders up to its own day."""
    pairs = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    pairs = pairs.select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("tag")).distinct()
    tagged = _order_days(spark, folder).join(pairs, "o_orderkey", "left")
    return _plain(tags.popularity_per_row(tagged, key="o_orderkey", day="d", tag="tag"))


_FRAME_COLUMNS = """m.cve_id, m.published_date, m.exploited_30d, m.in_kev,
  CAST(m.cvss_v3_base_score AS DOUBLE) AS cvss_v3_base_score"""
_FRAME_TAIL = """
  t.f_cve_year, t.f_cve_month, t.f_cve_weekday, t.f_age_days,
  t.f_cves_published_same_week, t.f_cves_published_same_month,
  g.f_max_cwe_popularity, g.f_mean_cwe_popularity, g.f_cwe_distinct_count"""


def _frame_sql(scores: str, score: str, percentile: str, age: str, counts: str, rated: str) -> str:
    return f"""
    {derived.WITH_MASTER}{scores}, {_TAGGED}, {rated}, graph AS ({_summary("cve_id")}),
    dated AS (SELECT cve_id, published_date AS d FROM nvd),
    times AS (SELECT cve_id, {_CALENDAR}, {age} AS f_age_days, {counts} FROM dated)
    SELECT {_FRAME_COLUMNS}, CAST({score} AS DOUBLE) AS f_epss_score,
      CAST({percentile} AS DOUBLE) AS f_epss_percentile, {_TABULAR}, {_FRAME_TAIL}
    FROM master m JOIN times t ON t.cve_id = m.cve_id JOIN graph g ON g.cve_id = m.cve_id
    """ + ("JOIN as_of a ON a.cve_id = m.cve_id" if scores else "")


@query(
    _frame_sql(
        ", " + _AS_OF,
        "coalesce(a.epss_score, 0)",
        "coalesce(a.epss_percentile, 0)",
        "0",
        _counts(_UPTO),
        _RATED_UPTO,
    )
)
def feature_frame_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """The full training frame, everything as of each row's own publication."""
    frame = feature_frame(
        derived.master(spark, folder), history=derived.history(spark, folder), include_graph=True
    )
    return _plain(frame)


@query(
    _frame_sql(
        "",
        "coalesce(m.epss_score, 0)",
        "coalesce(m.epss_percentile, 0)",
        "CAST((SELECT max(d) FROM dated) - d AS INTEGER)",
        _counts(),
        _RATED_ALL,
    )
)
def feature_frame_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The full scoring frame: current scores, everything as of the latest day."""
    frame = feature_frame(derived.master(spark, folder), point_in_time=False, include_graph=True)
    return _plain(frame)


@query(derived.WITH_MASTER + f" SELECT {_FRAME_COLUMNS}, CAST(0 AS DOUBLE) AS f_none FROM master m")
def feature_frame_bare(spark: SparkSession, folder: str) -> DataFrame:
    """Base columns only: every optional family left out."""
    frame = feature_frame(
        derived.master(spark, folder), point_in_time=False, include_tabular=False, include_temporal=False
    )
    return _plain(frame.select(*BASE, F.lit(0.0).alias("f_none")))
