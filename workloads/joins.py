"""As-of joins, fallbacks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.asof import asof_join, asof_lookup
from riskloom.operators.assemble import epss_as_of, epss_current
from riskloom.operators.score import baseline_lookup
from workloads import derived
from workloads.registry import query, table


@query(
    """
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    v AS (SELECT event_id AS vid, user_id, ts AS vts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, p.user_id, coalesce(v.value, 0.0) AS view_value, v.vts AS view_ts
    FROM p LEFT JOIN (
      SELECT p.event_id, max(struct_pack(vts := v.vts, vid := v.vid, value := v.value)) AS best
      FROM p JOIN v ON p.user_id = v.user_id AND v.vts <= p.ts GROUP BY p.event_id
    ) b ON b.event_id = p.event_id
    LEFT JOIN v ON v.vid = b.best.vid
    """
)
def asof_join_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every purchase with the value of the user's latest view up to that moment."""
    events = table(spark, folder, "events")
    return asof_join(
        events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
        events.where("event_type = 'view'"),
        on=["user_id"],
        left_time="ts",
        right_time="ts",
        values={"view_value": "value"},
        tie_break=["event_id"],
        fill={"view_value": 0.0},
        matched="view_ts",
    ).drop("ts")


@query(
    """
    WITH l AS (SELECT l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d, l_quantity FROM lineitem),
    best AS (
      SELECT part_day.l_partkey, part_day.d,
        max(struct_pack(t := l.d, q := l.l_quantity, s := l.l_suppkey)) AS b
      FROM (SELECT DISTINCT l_partkey, d FROM l) part_day
      JOIN l ON l.l_partkey = part_day.l_partkey AND l.d <= part_day.d
      GROUP BY part_day.l_partkey, part_day.d)
    SELECT l.l_partkey, l.d AS ship_date, l.l_quantity, best.b.t AS seen_on, best.b.q AS seen_quantity
    FROM l JOIN best ON best.l_partkey = l.l_partkey AND best.d = l.d
    """
)
def asof_join_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as of their own day per part: many left and right rows share a key and a day."""
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_date"), "l_quantity"
    )
    return asof_join(
        lines.select("l_partkey", "ship_date", "l_quantity"),
        lines,
        on=["l_partkey"],
        left_time="ship_date",
        right_time="ship_date",
        values={"seen_quantity": "l_quantity"},
        tie_break=["l_quantity", "l_suppkey"],
        matched="seen_on",
    )


_AS_OF = """
as_of AS (
  SELECT cve_id, published_date, b.s AS epss_score, b.p AS epss_percentile FROM (
    SELECT nvd.cve_id, nvd.published_date, max(CASE WHEN h.cve_id IS NOT NULL THEN
      struct_pack(d := h.snapshot_date, s := h.epss_score, p := h.epss_percentile) END) AS b
    FROM nvd LEFT JOIN history h ON h.cve_id = nvd.cve_id AND h.snapshot_date <= nvd.published_date
    GROUP BY nvd.cve_id, nvd.published_date))"""


AS_OF_SQL = f"""
    WITH {derived.NVD}, {derived.HISTORY}, {_AS_OF}
    SELECT cve_id, published_date, CAST(coalesce(epss_score, 0) AS DOUBLE) AS f_epss_score,
      CAST(coalesce(epss_percentile, 0) AS DOUBLE) AS f_epss_percentile FROM as_of
    """


@query(AS_OF_SQL)
def asof_lookup_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score known at publication for every vulnerability."""
    return scores_as_of(derived.nvd(spark, folder), derived.history(spark, folder))


def scores_as_of(nvd: DataFrame, history: DataFrame, right_unique: bool = False) -> DataFrame:
    values = {"f_epss_score": "epss_score", "f_epss_percentile": "epss_percentile"}
    found = asof_lookup(
        nvd.select("cve_id", "published_date"),
        history,
        on="cve_id",
        left_time="published_date",
        right_time="snapshot_date",
        values=values,
        fill=dict.fromkeys(values, 0.0),
        right_unique=right_unique,
    )
    return found.select("cve_id", "published_date", *[F.col(v).cast("double").alias(v) for v in values])


@query(
    f"""
    WITH {derived.HISTORY}, points AS (
      SELECT {derived.LINE_ID} AS cve_id, CAST(l_shipdate AS DATE) AS d, l_linenumber FROM lineitem)
    SELECT p.cve_id, p.d, p.l_linenumber, CAST(coalesce(b.b.s, 0) AS DOUBLE) AS score, b.b.d AS seen_on FROM points p
    LEFT JOIN (
      SELECT p.cve_id, p.d, max(struct_pack(d := h.snapshot_date, s := h.epss_score, p := h.epss_percentile)) AS b
      FROM (SELECT DISTINCT cve_id, d FROM points) p JOIN history h ON h.cve_id = p.cve_id AND h.snapshot_date <= p.d
      GROUP BY p.cve_id, p.d) b ON b.cve_id = p.cve_id AND b.d = p.d
    """
)
def asof_lookup_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The score known on the ship day of every line: an id has several days."""
    points = table(spark, folder, "lineitem").select(
        derived.cve("CVE-2024-", "l_orderkey").alias("cve_id"), F.to_date("l_shipdate").alias("d"), "l_linenumber"
    )
    found = asof_lookup(
        points,
        derived.history(spark, folder),
        on="cve_id",
        left_time="d",
        right_time="snapshot_date",
        values={"score": "epss_score", "_p": "epss_percentile"},
        fill={"score": 0.0},
        matched="seen_on",
    )
    return found.select("cve_id", "d", "l_linenumber", F.col("score").cast("double").alias("score"), "seen_on")


_EPSS_OUT = "cve_id, CAST({s} AS DOUBLE) AS f_epss_score, CAST({p} AS DOUBLE) AS f_epss_percentile FROM master"
_KNOWN = "CASE WHEN epss_snapshot_date <= published_date THEN coalesce({c}, 0) ELSE 0 END"


def _two(df: DataFrame) -> DataFrame:
    return df.select(
        "cve_id",
        F.col("f_epss_score").cast("double").alias("f_epss_score"),
        F.col("f_epss_percentile").cast("double").alias("f_epss_percentile"),
    )


@query(
    derived.WITH_MASTER
    + " SELECT "
    + _EPSS_OUT.format(s=_KNOWN.format(c="epss_score"), p=_KNOWN.format(c="epss_percentile"))
)
def asof_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Without a history: a row's own score if its snapshot is no later than publication."""
    return _two(epss_as_of(derived.master(spark, folder), None))


@query(
    derived.WITH_MASTER
    + " SELECT "
    + _EPSS_OUT.format(s="coalesce(epss_score, 0)", p="coalesce(epss_percentile, 0)")
)
def current_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Latest scores whatever their date, null as 0."""
    return _two(epss_current(derived.master(spark, folder)))


@query(
    f"""
    WITH {derived.HISTORY}, {derived.KEV}, {derived.NVD}, {derived.MASTER}
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
      CAST(coalesce(m.epss_score, 0) AS DOUBLE) AS epss_score,
      CAST(coalesce(m.epss_percentile, 0) AS DOUBLE) AS epss_percentile, m.cve_id IS NOT NULL AS known
    FROM lineitem l LEFT JOIN master m
      ON m.cve_id = {derived.cve_sql("CVE-2024-", "l.l_orderkey + l.l_linenumber * 3000")}
    """
)
def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline lookup for many requests, some of them unknown."""
    lines = table(spark, folder, "lineitem").withColumn(
        "_n", F.col("l_orderkey") + F.col("l_linenumber") * 3000
    )
    requests = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", derived.cve("CVE-2024-", "_n").alias("cve_id")
    )
    return baseline_lookup(requests, derived.master(spark, folder)).drop("cve_id")
