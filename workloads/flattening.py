"""Nested records, identifiers and CSV-like text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.identifiers import component_purl, cpe_parts, cve_id_in, purl_parts
from riskloom.operators.flatten import flatten_nvd
from riskloom.session import spread
from riskloom.sources.landing import kev_rows, nvd_rows
from workloads import derived
from workloads.registry import query, table


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(spark: SparkSession, folder: str) -> DataFrame:
    """One property out of each event's JSON."""
    return table(spark, folder, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k")
    )


def _text(value: Column) -> Column:
    return value.cast("string")


def nvd_records(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON record per part, wrapped for even keys and bare for odd ones."""
    key, size = F.col("p_partkey"), F.col("p_size")
    published = F.concat(F.lit("20"), F.lpad(_text(key % 24), 2, "0"), F.lit("-03-1"), _text(key % 9), F.lit("T23:59:59.999Z"))
    modified = F.concat(F.lit("20"), F.lpad(_text(size % 30), 2, "0"), F.lit("-01-02T00:00:00.000"))

    def cvss(kind: str, score: Column, severity: Column) -> Column:
        data = F.struct(
            score.alias("baseScore"), severity.alias("baseSeverity"), F.lit(f"CVSS:3.{kind}/AV:N").alias("vectorString")
        )
        other = F.struct(
            F.lit(1.5).alias("baseScore"), F.lit("none").alias("baseSeverity"), F.lit("x").alias("vectorString")
        )
        return F.array(
            F.struct(F.lit("Secondary").alias("type"), other.alias("cvssData")),
            F.struct(F.lit("Primary").alias("type"), data.alias("cvssData")),
        )

    metrics = F.struct(
        F.when(key % 3 != 0, cvss("1", F.when(key % 3 == 1, size / 5), F.lit("high"))).alias("cvssMetricV31"),
        F.when(key % 4 != 0, cvss("0", size / 10, F.lit("Low"))).alias("cvssMetricV30"),
    )
    descriptions = F.array(
        F.struct(F.lit("fr").alias("lang"), F.lit("pas ceci").alias("value")),
        F.struct(F.when(key % 5 == 0, "es").otherwise("en").alias("lang"), F.col("p_name").alias("value")),
    )
    weak = F.array(
        F.struct(
            F.array(
                F.struct(F.concat(F.lit("CWE-"), _text(key % 17)).alias("value")),
                F.struct(F.lit("NVD-CWE-Other").alias("value")),
            ).alias("description")
        ),
        F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), _text(size % 5)).alias("value"))).alias("description")),
    )
    cpe = F.concat(
        F.lit("cpe:2.3:a:"),
        F.lower("p_brand"),
        F.lit(":"),
        F.lower("p_type"),
        F.lit(":"),
        F.when(key % 2 == 0, "*").otherwise(_text(size)),
        F.lit(":*"),
    )
    configurations = F.array(
        F.struct(
            F.array(
                F.struct(
                    F.array(
                        F.struct(cpe.alias("criteria"), F.lit(None).cast("string").alias("cpe23Uri")),
                        F.struct(F.lit(None).cast("string").alias("criteria"), F.lit("cpe:2.3:o:acme:base:1.0").alias("cpe23Uri")),
                        F.struct(F.lit("not a cpe").alias("criteria"), F.lit(None).cast("string").alias("cpe23Uri")),
                    ).alias("cpeMatch")
                )
            ).alias("nodes")
        )
    )
    references = F.array(
        F.struct(F.array(F.lit("Vendor Advisory"), F.when(key % 6 == 0, "EXPLOIT").otherwise("x")).alias("tags")),
        F.struct(F.when(key % 7 == 0, F.array(F.lit("Patch"))).alias("tags")),
    )
    body = [
        derived.cve("CVE-2023-", "p_partkey").alias("id"),
        F.when(key % 50 != 49, published).alias("published"),
        modified.alias("lastModified"),
        descriptions.alias("descriptions"),
        metrics.alias("metrics"),
        F.when(key % 8 != 0, weak).alias("weaknesses"),
        F.when(key % 9 != 0, configurations).alias("configurations"),
        references.alias("references"),
    ]
    wrapped = F.to_json(F.struct(F.struct(*body).alias("cve")))
    text = F.when(key % 2 == 0, wrapped).otherwise(F.to_json(F.struct(*body)))
    parts = spread(table(spark, folder, "part"))
    return parts.select(F.col("p_partkey").alias("_pos"), text.alias("_json"))


NVD_FLAT = f"""
SELECT {derived.cve_sql("CVE-2023-", "p_partkey")} AS cve_id, pub AS published_date,
  greatest(mod, pub) AS last_modified_date,
  CAST(CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size / 5.0 WHEN p_partkey % 4 <> 0 THEN p_size / 10.0 END
    AS FLOAT) AS DOUBLE) AS cvss_v3_base_score,
  CASE WHEN p_partkey % 3 = 1 THEN 'HIGH' WHEN p_partkey % 4 <> 0 THEN 'LOW' WHEN p_partkey % 3 = 2 THEN 'HIGH' END
    AS cvss_v3_severity,
  CASE WHEN p_partkey % 3 = 1 THEN 'CVSS:3.1/AV:N' WHEN p_partkey % 4 <> 0 THEN 'CVSS:3.0/AV:N'
    WHEN p_partkey % 3 = 2 THEN 'CVSS:3.1/AV:N' END AS cvss_v3_vector,
  CASE WHEN p_partkey % 8 <> 0 THEN array_to_string(list_sort(list_distinct(
    ['CWE-' || CAST(p_partkey % 17 AS VARCHAR), 'CWE-' || CAST(p_size % 5 AS VARCHAR)])), '|') END AS cwe_ids,
  CASE WHEN p_partkey % 9 <> 0 THEN 2 ELSE 0 END AS vendor_count,
  CASE WHEN p_partkey % 9 <> 0 THEN 2 ELSE 0 END AS product_count,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS description,
  CAST(length(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END) AS INTEGER) AS description_len,
  p_partkey % 6 = 0 AS ref_has_exploit, p_partkey % 7 = 0 AS ref_has_patch,
  CASE WHEN p_partkey % 9 <> 0 THEN array_to_string(list_sort(['acme', lower(p_brand)]), '|') END AS vendors,
  CASE WHEN p_partkey % 9 <> 0 THEN array_to_string(list_sort(['base', lower(p_type)]), '|') END AS products,
  CASE WHEN p_partkey % 9 <> 0 THEN array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 2 = 0
    THEN ['1.0'] ELSE ['1.0', CAST(p_size AS VARCHAR)] END)), '|') END AS versions
FROM (SELECT *,
  CAST('20' || lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || '-03-1' || CAST(p_partkey % 9 AS VARCHAR) AS DATE) AS pub,
  CAST('20' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || '-01-02' AS DATE) AS mod
  FROM part WHERE p_partkey % 50 <> 49)
"""


def joined_lists(df: DataFrame) -> DataFrame:
    for name, dtype in df.dtypes:
        if dtype == "array<string>":
            df = df.withColumn(name, F.array_join(name, "|"))
        elif dtype == "float":
            df = df.withColumn(name, F.col(name).cast("double"))
    return df


@query(NVD_FLAT)
def nvd_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Nested records to flat rows."""
    return joined_lists(flatten_nvd(nvd_records(spark, folder), "_json"))


@query(
    """
    SELECT count(*) AS n, count(DISTINCT cve_id) AS n_ids, min(pos) AS first_pos, max(pos) AS last_pos FROM (
      SELECT 'CVE-2023-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS cve_id, p_partkey AS pos
      FROM part WHERE p_partkey % 50 <> 49)
    """
)
def nvd_bronze_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze rows when every record arrives twice: the first of each id stays."""
    once = nvd_records(spark, folder).withColumn("_copy", F.lit(0))
    twice = once.unionByName(once.withColumn("_copy", F.lit(1)))
    rows = nvd_rows(twice, order=("_copy", "_pos"))
    number = F.substring("cve_id", 10, 12).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("cve_id").alias("n_ids"),
        F.min(number).alias("first_pos"),
        F.max(number).alias("last_pos"),
    )


@query(
    f"""
    SELECT cve_id, 'vendor ' || CAST(l_suppkey AS VARCHAR) AS vendor_project, date_added,
      CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE date_added + 14 END AS due_date
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn
      FROM (SELECT *, CAST(l_shipdate AS DATE) AS date_added, {derived.LINE_ID} AS cve_id
        FROM lineitem WHERE l_quantity <> 7)) WHERE rn = 1
    """
)
def kev_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries in JSON: bad dates null, rows without id or date dropped, first per id."""
    day = _text(F.to_date("l_shipdate"))
    entry = F.struct(
        derived.cve("CVE-2024-", "l_orderkey").alias("cveID"),
        F.concat(F.lit("vendor "), _text(F.col("l_suppkey"))).alias("vendorProject"),
        F.when(F.col("l_quantity") != 7, F.concat(day, F.lit("T00:00"))).otherwise("unknown").alias("dateAdded"),
        F.when(F.col("l_partkey") % 4 == 0, "soon")
        .otherwise(_text(F.date_add(F.to_date("l_shipdate"), 14)))
        .alias("dueDate"),
    )
    entries = spread(table(spark, folder, "lineitem")).select(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.to_json(entry).alias("_json")
    )
    rows = kev_rows(entries, order=("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return rows.select("cve_id", "vendor_project", "date_added", "due_date")


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_brand) END AS vendor,
      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS product,
      CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS version
    FROM part
    """
)
def cpe_split(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor, product and version of CPE names; a third without a version, a fifth malformed."""
    uri = F.concat(
        F.when(F.col("p_partkey") % 5 == 0, "cpx").otherwise("cpe"),
        F.lit(":2.3:a:"),
        F.lower("p_brand"),
        F.lit(":"),
        F.col("p_name"),
        F.when(F.col("p_partkey") % 3 == 0, ":*").otherwise(F.concat(F.lit(":"), _text(F.col("p_size")))),
        F.lit(":*:*"),
    )
    parts = table(spark, folder, "part").select("p_partkey", cpe_parts(uri).alias("c"))
    return parts.select("p_partkey", "c.vendor", "c.product", "c.version")


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN lower(p_type) END AS type,
      CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN '@' || lower(p_brand) END AS namespace,
      CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name,
      CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) || '+1' END AS version
    FROM part
    """
)
def purl_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Package URLs with encoded scopes and names, qualifiers and subpaths."""
    key = F.col("p_partkey")
    purl = F.concat(
        F.when(key % 7 == 0, "pkx:").otherwise("pkg:"),
        F.lower("p_type"),
        F.when(key % 2 == 0, F.concat(F.lit("/%40"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("%23")))).otherwise(""),
        F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("%20")),
        F.when(key % 3 != 0, F.concat(F.lit("@"), _text(F.col("p_size")), F.lit("+1"))).otherwise(""),
        F.when(key % 4 == 0, "?arch=x86&os=a").otherwise(""),
        F.when(key % 5 == 0, "#sub/path").otherwise(""),
    )
    parts = table(spark, folder, "part").select("p_partkey", purl_parts(purl).alias("u"))
    return parts.select("p_partkey", "u.type", "u.namespace", "u.name", "u.version")


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL
      ELSE 'CVE-20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS cve_id
    FROM part
    """
)
def cve_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Ids found in mixed-case text; short numbers do not count."""
    key = F.col("p_partkey")
    number = F.when(key % 4 == 0, "123").otherwise(F.lpad(_text(key), 12, "0"))
    text = F.concat(F.lit("see cVe-20"), F.lpad(_text(F.col("p_size")), 2, "0"), F.lit("-"), number, F.lit(" ok"))
    return table(spark, folder, "part").select("p_partkey", cve_id_in(text).alias("cve_id"))


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'pkg:x/' || p_type WHEN p_partkey % 5 = 1 THEN 'pkg:y/' || p_brand
      WHEN p_partkey % 5 = 2 THEN 'pkg:generic/' || p_name WHEN p_partkey % 5 = 3
      THEN 'pkg:generic/' || p_name || '@' || CAST(p_size AS VARCHAR) END AS purl
    FROM part
    """
)
def purl_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit purl, bom-ref, generic purl with and without version, or none."""
    kind = F.col("p_partkey") % 5
    purl = component_purl(
        F.when(kind == 0, F.concat(F.lit("pkg:x/"), "p_type")).otherwise(""),
        F.when(kind == 1, F.concat(F.lit("pkg:y/"), "p_brand")).otherwise("ref-1"),
        F.when(kind.isin(2, 3), F.col("p_name")),
        F.when(kind == 3, _text(F.col("p_size"))).otherwise(""),
    )
    return table(spark, folder, "part").select("p_partkey", purl.alias("purl"))
