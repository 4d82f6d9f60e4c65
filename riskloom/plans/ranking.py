"""A corpus of software inventories to ranked vulnerabilities, in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.match import match_components, product_index
from riskloom.operators.score import rank_matches, score_ids
from riskloom.sources.bronze import read_nvd_bronze, read_or_none
from riskloom.sources.sbom import parse_documents

COLUMNS = (
    "doc_id",
    "rank",
    "cve_id",
    "purl",
    "probability",
    "percentile",
    "cvss_v3_base_score",
    "in_kev",
    "match_method",
    "match_confidence",
    "match_reason",
)


@dataclass(frozen=True)
class Ranking:
    """Ranked matches, rejected documents, and why product matches are missing, if they are."""

    ranked: DataFrame
    rejects: DataFrame
    degraded_reason: str | None = None

    @property
    def degraded(self) -> bool:
        return self.degraded_reason is not None


def load_product_index(spark: SparkSession, nvd_path: str) -> DataFrame | None:
    """The index, or ``None`` when the table is absent or its files list no products.

    A table that is there and cannot be read is an error.
    """
    table = read_or_none(spark, nvd_path)
    if table is None or "products" not in table.columns:
        return None
    return product_index(read_nvd_bronze(spark, nvd_path))


def rank_documents(
    documents: DataFrame,
    master: DataFrame,
    *,
    index: DataFrame | None = None,
    predictions: DataFrame | None = None,
) -> Ranking:
    """Matches of every document, best first; a document without matches has no rows.

    Without an index only matches that documents state themselves are ranked, and the result says so.
    """
    inventory = parse_documents(documents)
    found = match_components(inventory.components, inventory.inline, index)
    scored = score_ids(found, master, predictions)
    reason = "no product index: only stated matches are ranked" if index is None else None
    return Ranking(rank_matches(scored).select(*COLUMNS), inventory.rejects, reason)
