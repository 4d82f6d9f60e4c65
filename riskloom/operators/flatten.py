"""Vulnerability records, one JSON text per row, to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import nvd_record as nvd
from riskloom.functions.scalars import iso_date, list_size, none_if_empty
from riskloom.operators.once import compute_once
from riskloom.schemas import NVD_BRONZE


def flatten_nvd(records: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows of the records that carry an id and both dates; ``keep`` columns ride along.

    A field of the wrong type becomes null on its own; a text that is no JSON
    object has no id and drops out with the records that lack required fields.
    """
    parsed = compute_once(records, keep, F.from_json(F.col(text), nvd.RECORD_TYPE), "_j")
    body = compute_once(parsed, keep, nvd.unwrapped(F.col("_j")), "_r")
    dated = body.select(
        "*",
        none_if_empty(F.col("_r.id")).alias("cve_id"),
        iso_date(F.col("_r.published")).alias("published_date"),
        iso_date(F.col("_r.lastModified")).alias("_modified"),
    ).where("cve_id is not null and published_date is not null and _modified is not null")
    filled = dated.select(
        "*",
        nvd.english_text(F.col("_r.descriptions")).alias("description"),
        nvd.cvss_v3(F.col("_r.metrics")).alias("_cvss"),
        nvd.cwe_set(F.col("_r.weaknesses")).alias("cwe_ids"),
        nvd.cpe_list(F.col("_r.configurations")).alias("_cpe"),
        nvd.tagged(F.col("_r.references"), "exploit").alias("ref_has_exploit"),
        nvd.tagged(F.col("_r.references"), "patch").alias("ref_has_patch"),
    )
    named = filled.select(
        "*",
        *[nvd.field_set(F.col("_cpe"), f).alias(f"{f}s") for f in ("vendor", "product", "version")],
    )
    return (
        named.withColumn("last_modified_date", F.greatest("_modified", "published_date"))
        .withColumn("cvss_v3_base_score", F.col("_cvss.base"))
        .withColumn("cvss_v3_severity", F.col("_cvss.severity"))
        .withColumn("cvss_v3_vector", F.col("_cvss.vector"))
        .withColumn("vendor_count", list_size(F.col("vendors")))
        .withColumn("product_count", list_size(F.col("products")))
        .withColumn("description_len", F.length("description"))
        .select(*keep, *NVD_BRONZE.names)
    )
