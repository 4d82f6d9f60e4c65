"""Per-row features of the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import has_text, list_size, lookup

# Ordinal rank of each severity; anything else ranks 0.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def tabular_columns() -> list[Column]:
    """The ten ``f_`` columns over the master table's columns."""
    vector = F.col("cvss_v3_vector")
    return [
        F.coalesce(F.col("cvss_v3_base_score").cast("float"), F.lit(0.0).cast("float")).alias(
            "f_cvss_v3_base_score"
        ),
        lookup(F.col("cvss_v3_severity"), SEVERITY_RANK).cast("int").alias("f_cvss_v3_severity_rank"),
        has_text(vector, "AV:N").alias("f_cvss_av_network"),
        # Version 2 syntax, so 0 for every well-formed version 3 vector.
        has_text(vector, "Au:N").alias("f_cvss_au_none"),
        list_size(F.col("cwe_ids")).alias("f_cwe_count"),
        F.col("vendor_count").cast("int").alias("f_vendor_count"),
        F.col("product_count").cast("int").alias("f_product_count"),
        F.col("description_len").cast("int").alias("f_description_len"),
        F.col("ref_has_exploit").cast("byte").alias("f_ref_has_exploit"),
        F.col("ref_has_patch").cast("byte").alias("f_ref_has_patch"),
    ]


def tabular_frame(master: DataFrame) -> DataFrame:
    """Key, publication date and the tabular features."""
    return master.select("cve_id", "published_date", *tabular_columns())
