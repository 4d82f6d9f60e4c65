"""Column contracts of the stored tables. Column order is part of each contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

STRINGS = ArrayType(StringType())


def _table(*columns: tuple[str, DataType, bool]) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in columns])


NVD_BRONZE = _table(
    ("cve_id", StringType(), False),
    ("published_date", DateType(), False),
    ("last_modified_date", DateType(), False),
    ("cvss_v3_base_score", FloatType(), True),
    ("cvss_v3_severity", StringType(), True),
    ("cvss_v3_vector", StringType(), True),
    ("cwe_ids", STRINGS, True),
    ("vendor_count", IntegerType(), False),
    ("product_count", IntegerType(), False),
    ("description", StringType(), False),
    ("description_len", IntegerType(), False),
    ("ref_has_exploit", BooleanType(), False),
    ("ref_has_patch", BooleanType(), False),
    ("vendors", STRINGS, True),
    ("products", STRINGS, True),
    ("versions", STRINGS, True),
)

KEV_BRONZE = _table(
    ("cve_id", StringType(), False),
    ("vendor_project", StringType(), True),
    ("product", StringType(), True),
    ("vulnerability_name", StringType(), True),
    ("date_added", DateType(), False),
    ("short_description", StringType(), True),
    ("required_action", StringType(), True),
    ("due_date", DateType(), True),
    ("known_ransomware_campaign_use", StringType(), True),
    ("notes", StringType(), True),
)

EPSS_BRONZE = _table(
    ("cve_id", StringType(), False),
    ("epss_score", FloatType(), False),
    ("epss_percentile", FloatType(), False),
    ("snapshot_date", DateType(), False),
)

CVE_MASTER = _table(
    ("cve_id", StringType(), False),
    ("published_date", DateType(), False),
    ("last_modified_date", DateType(), False),
    ("cvss_v3_base_score", FloatType(), True),
    ("cvss_v3_severity", StringType(), True),
    ("cvss_v3_vector", StringType(), True),
    ("cwe_ids", STRINGS, True),
    ("vendor_count", IntegerType(), False),
    ("product_count", IntegerType(), False),
    ("description_len", IntegerType(), False),
    ("ref_has_exploit", BooleanType(), False),
    ("ref_has_patch", BooleanType(), False),
    ("epss_score", FloatType(), True),
    ("epss_percentile", FloatType(), True),
    ("epss_snapshot_date", DateType(), True),
    ("in_kev", BooleanType(), False),
    ("kev_date_added", DateType(), True),
    ("exploited_30d", BooleanType(), False),
)


def conform(df: DataFrame, contract: StructType) -> DataFrame:
    """Select and cast to ``contract`` in its column order; absent columns are an error."""
    missing = [name for name in contract.names if name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in contract])
