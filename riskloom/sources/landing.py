"""Landed feed files to bronze rows. The landing folder is the source; nothing is fetched."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.functions.scalars import iso_date, none_if_empty
from riskloom.operators.dedup import keep_first
from riskloom.operators.flatten import flatten_nvd
from riskloom.operators.once import compute_once
from riskloom.schemas import EPSS_BRONZE, KEV_BRONZE, NVD_BRONZE, conform
from riskloom.session import spread
from riskloom.sources.pages import page_records

# Catalog field names and their columns.
KEV_FIELDS = {
    "cveID": "cve_id",
    "vendorProject": "vendor_project",
    "product": "product",
    "vulnerabilityName": "vulnerability_name",
    "dateAdded": "date_added",
    "shortDescription": "short_description",
    "requiredAction": "required_action",
    "dueDate": "due_date",
    "knownRansomwareCampaignUse": "known_ransomware_campaign_use",
    "notes": "notes",
}
_KEV_ENTRY = "struct<" + ",".join(f"{name}:string" for name in KEV_FIELDS) + ">"

EPSS_CSV = StructType([StructField(n, StringType()) for n in ("cve", "epss", "percentile")])
# The last date in a file's path: in its own name or in its folder's.
_DAY_IN_PATH = r".*(\d{4}-\d{2}-\d{2})"


def day_of_file(path: str = "_metadata.file_path") -> Column:
    """The day a landed file belongs to, from its path."""
    return F.to_date(F.regexp_extract(F.col(path), _DAY_IN_PATH, 1))


class FeedError(RuntimeError):
    """A landed feed is malformed or holds no usable row."""


def _entries(spark: SparkSession, path: str, split_pages: bool = False) -> DataFrame:
    """One row per element of each file's ``vulnerabilities`` list, as raw JSON text."""
    if split_pages:
        return page_records(spark, path)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("_file"),
        F.from_json("value", "vulnerabilities array<string>").alias("_doc"),
    )
    return spread(files.select("_file", F.posexplode("_doc.vulnerabilities").alias("_pos", "_json")))


def _usable_kev(entries: DataFrame, text: str, order: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Catalog rows with an id and a day, and the columns that place them."""
    places = [f"_o{i}" for i in range(len(order))]
    placed = entries.select(text, *[F.col(name).alias(place) for name, place in zip(order, places)])
    parsed = compute_once(placed, places, F.from_json(text, _KEV_ENTRY), "_e").select(
        *places, *[F.col(f"_e.{source}").alias(out) for source, out in KEV_FIELDS.items()]
    )
    usable = (
        parsed.withColumn("cve_id", none_if_empty(F.col("cve_id")))
        .withColumn("date_added", iso_date(F.col("date_added")))
        .withColumn("due_date", iso_date(F.col("due_date")))
        .where("cve_id is not null and date_added is not null")
    )
    return usable, places


def kev_rows(entries: DataFrame, text: str = "_json", order: tuple[str, ...] = ("_file", "_pos")) -> DataFrame:
    """Catalog rows from JSON entries: usable ones only, the first per id."""
    usable, places = _usable_kev(entries, text, order)
    return conform(keep_first(usable, ["cve_id"], places), KEV_BRONZE)


def read_kev(spark: SparkSession, path: str, *, split_pages: bool = False) -> DataFrame:
    """Exploit catalog files; an absent list or no usable row is an error. ``split_pages``: see ``read_nvd``."""
    entries = _entries(spark, path, split_pages)
    # The first usable entry tells; repeated ids need not be told apart for it.
    if _usable_kev(entries, "_json", ())[0].isEmpty():
        raise FeedError(f"no usable catalog entries in {path}")
    return kev_rows(entries)


def read_epss_csv(spark: SparkSession, path: str, snapshot: date | None = None) -> DataFrame:
    """Daily score files, plain or gzipped; the day is given or comes from the file's path.

    Comment lines start with ``#``. The first three header names are checked
    against the file; a different header is an error when the file is read.
    """
    header = _checked_header(spark, path)
    raw = spark.read.option("recursiveFileLookup", True).csv(
        path, header=True, comment="#", schema=header, enforceSchema=False
    )
    day = F.lit(snapshot) if snapshot else day_of_file()
    rows = raw.select(
        F.col("cve").alias("cve_id"),
        F.col("epss").cast("float").alias("epss_score"),
        F.col("percentile").cast("float").alias("epss_percentile"),
        day.alias("snapshot_date"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).where(F.col("cve_id").isNotNull())
    # Within a file, blocks are read in order and lines are numbered as read.
    first = keep_first(rows, ["cve_id", "snapshot_date"], ["_file", "_block", "_line"])
    return conform(first, EPSS_BRONZE)


def _checked_header(spark: SparkSession, path: str) -> StructType:
    """The file's columns as strings; extra columns may follow the three known ones."""
    texts = spark.read.option("recursiveFileLookup", True).text(path)
    lines = texts.where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    first = lines.first()
    if first is None:
        raise FeedError(f"no data lines in {path}")
    names = first["value"].lower().split(",")
    if names[:3] != EPSS_CSV.names:
        raise FeedError(f"unexpected header: {names}")
    extra = [StructField(n, StringType()) for n in names[3:]]
    return StructType([*EPSS_CSV.fields, *extra])


def nvd_rows(
    entries: DataFrame,
    text: str = "_json",
    order: tuple[str, ...] = ("_file", "_pos"),
) -> DataFrame:
    """Vulnerability rows from JSON records: the first per id in arrival order."""
    places = [f"_o{i}" for i in range(len(order))]
    placed = entries.select(text, *[F.col(name).alias(place) for name, place in zip(order, places)])
    flat = flatten_nvd(placed, text, keep=tuple(places))
    return conform(keep_first(flat, ["cve_id"], places), NVD_BRONZE)


def read_nvd(spark: SparkSession, path: str, *, lines: bool = False, split_pages: bool = False) -> DataFrame:
    """Vulnerability records from page files (a ``vulnerabilities`` list) or one per line.

    Line files split across tasks; page files are read one task each, or with ``split_pages`` by byte range, for files
    too large for one task. Files without a single usable record are an error.
    """
    if lines:
        entries = spark.read.text(path).select(
            F.col("_metadata.file_name").alias("_file"),
            F.struct(
                F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
            ).alias("_pos"),
            F.col("value").alias("_json"),
        )
    else:
        entries = _entries(spark, path, split_pages)
    # The first usable record tells; repeated ids need not be told apart for it.
    if flatten_nvd(entries, "_json").isEmpty():
        raise FeedError(f"no usable vulnerability records in {path}")
    return nvd_rows(entries)
