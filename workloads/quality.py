"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import quality
from riskloom.operators.quality import Rule
from riskloom.schemas import CVE_MASTER
from workloads import derived
from workloads.registry import query, table


@query(
    derived.WITH_MASTER
    + """, c AS (SELECT count(*) AS n,
      count(*) FILTER (WHERE NOT regexp_matches(cve_id, '^CVE-[0-9]{4}-[0-9]{4,}$')) AS b0,
      count(*) - count(DISTINCT cve_id) AS b1, count(*) FILTER (WHERE last_modified_date < published_date) AS b2,
      count(*) FILTER (WHERE cvss_v3_base_score NOT BETWEEN 0 AND 10) AS b3,
      count(*) FILTER (WHERE cvss_v3_severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) AS b4,
      count(*) FILTER (WHERE epss_score NOT BETWEEN 0 AND 1) AS b5,
      count(*) FILTER (WHERE epss_percentile NOT BETWEEN 0 AND 1) AS b6,
      count(*) FILTER (WHERE in_kev <> (kev_date_added IS NOT NULL)) AS b7,
      count(*) FILTER (WHERE len(list_filter(cwe_ids, lambda x: NOT regexp_matches(x, '^CWE-[0-9]+$'))) > 0) AS b8
      FROM master)
    SELECT k AS "check", n AS n_rows, b AS n_bad, b = 0 AS passed FROM (
      SELECT n, unnest([b0, b1, 0, b2, b3, b4, 0, 0, 0, 0, 0, 0, 0, b5, b6, b7, b8]) AS b,
        unnest(['cve_id_format', 'cve_id_unique', 'dates_present', 'modified_not_before_published',
          'cvss_v3_base_score_range', 'cvss_v3_severity_domain', 'vendor_count_non_negative',
          'product_count_non_negative', 'description_len_non_negative', 'ref_has_exploit_present',
          'ref_has_patch_present', 'in_kev_present', 'exploited_30d_present', 'epss_score_range',
          'epss_percentile_range', 'kev_date_iff_in_kev', 'cwe_id_format']) AS k FROM c)
    """
)
def quality_master(spark: SparkSession, folder: str) -> DataFrame:
    """Contract and value checks of the derived master table."""
    made = quality.validate(derived.master(spark, folder), CVE_MASTER, quality.master_rules())
    return made.drop("detail")


_BAD = """bad AS (SELECT
    count(*) AS n,
    count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '^[AN]$')) AS b0,
    count(*) - count(DISTINCT l_orderkey) AS b1,
    count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.08) AS b2,
    count(*) FILTER (WHERE l_linestatus <> 'O') AS b3,
    count(*) FILTER (WHERE l_quantity - 10 < 0) AS b4,
    count(*) FILTER (WHERE (l_returnflag = 'R') <> (l_linestatus = 'F')) AS b5,
    count(*) FILTER (WHERE l_partkey % 4 = 0) AS b6, count(*) FILTER (WHERE l_linenumber < l_suppkey % 7) AS b7,
    count(*) FILTER (WHERE l_returnflag = 'R') AS b8, min(CASE WHEN l_returnflag = 'R' THEN l_returnflag END) AS d8
    FROM lineitem)"""
_NAMES = "['format', 'unique', 'range', 'domain', 'non_negative', 'parity', 'present', 'order', 'elements']"


def _line_checks(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "*",
        (F.col("l_returnflag") == "R").alias("flag"),
        F.when(F.col("l_linestatus") == "F", F.lit(1)).alias("mark"),
        F.when(F.col("l_partkey") % 4 != 0, F.lit(1)).alias("maybe"),
        (F.col("l_suppkey") % 7).alias("floor"),
        (F.col("l_quantity") - 10).alias("rest"),
        F.array("l_linestatus", "l_returnflag").alias("pair"),
    )
    return quality.check(
        lines,
        [
            Rule("format", quality.matches("l_returnflag", "^[AN]$")),
            Rule("unique", quality.unique("l_orderkey")),
            Rule("range", quality.within("l_discount", 0.01, 0.08)),
            Rule("domain", quality.one_of("l_linestatus", ["O"])),
            Rule("non_negative", quality.never_negative("rest")),
            Rule("parity", quality.flag_iff_present("flag", "mark")),
            Rule("present", quality.not_null("l_tax", "maybe")),
            Rule("order", quality.in_order("floor", "l_linenumber")),
            Rule("elements", quality.elements_match("pair", "^[ANOF]$"), quality.bad_elements("pair", "^[ANOF]$")),
        ],
    )


@query(
    f"""WITH {_BAD} SELECT k AS "check", n AS n_rows, b AS n_bad, b = 0 AS passed,
      CASE WHEN k = 'elements' AND b > 0 THEN d8 END AS detail FROM (
      SELECT n, d8, unnest([b0, b1, b2, b3, b4, b5, b6, b7, b8]) AS b, unnest({_NAMES}) AS k FROM bad)"""
)
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every kind of rule on the lines, most of them violated."""
    return _line_checks(spark, folder)


@query(
    f"""WITH {_BAD} SELECT 'lineitem' AS "table", n AS n_rows,
      len(list_filter([b0, b1, b2, b3, b4, b5, b6, b7, b8], lambda b: b > 0)) AS n_errors, FALSE AS passed FROM bad"""
)
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same checks rolled up to one row."""
    return quality.roll_up(_line_checks(spark, folder), "lineitem").select(
        "table", "n_rows", "n_errors", "passed"
    )


_CONTRACT, _BROKEN = ", ".join(CVE_MASTER.names), ", ".join(CVE_MASTER.names[:-1])


@query(
    derived.WITH_MASTER
    + f""" SELECT 'schema' AS "check", n AS n_rows, n AS n_bad, FALSE AS passed, detail FROM (SELECT count(*) AS n FROM master),
      (SELECT unnest(['columns are {_BROKEN}; expected are {_CONTRACT}', 'cve_id is bigint; expected is string',
        'no column exploited_30d']) AS detail)"""
)
def quality_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A table that breaks the contract: a wrong type and a missing column stop the value checks."""
    broken = derived.master(spark, folder).withColumn("cve_id", F.length("cve_id").cast("long"))
    return quality.validate(broken.drop("exploited_30d"), CVE_MASTER, quality.master_rules())
