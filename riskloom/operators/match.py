"""Components of software inventories matched to vulnerabilities, best evidence first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.identifiers import purl_parts
from riskloom.functions.scalars import none_if_empty
from riskloom.operators.dedup import keep_first
from riskloom.operators.once import compute_once
from riskloom.session import cut_lineage

INLINE, EXACT, NAME = "inline_vex", "product_version_exact", "product_name"
# Confidence reported with each method.
CONFIDENCE = {INLINE: "high", EXACT: "medium", NAME: "low"}
# The reason reported with each method.
INLINE_REASON = "CycloneDX vulnerabilities[].id attached via affects.ref"
EXACT_REASON = "product '%s' with version '%s' matched NVD CPE versions"
NAME_REASON = "product '%s' matched NVD products without version equality (higher false-positive risk)"
COLUMNS = ("doc_id", "purl", "cve_id", "match_method", "match_confidence", "match_reason", "tier", "pos")


def product_index(nvd: DataFrame) -> DataFrame | None:
    """(product, cve_id, versions), lower-cased; ``None`` when the table lists no products.

    Versions are pooled over a vulnerability's products, as the table stores them.
    """
    if "products" not in nvd.columns:
        return None
    if "versions" in nvd.columns:
        tidy = F.filter("versions", lambda v: v.isNotNull())
        versions = F.transform(tidy, lambda v: F.lower(v))
    else:
        versions = F.lit(None).cast("array<string>")
    # Names repeat within a row only, as the table holds an id once; so nothing is shuffled to tell them apart.
    products = F.array_distinct(F.transform(F.filter("products", lambda p: p.isNotNull()), lambda p: F.lower(p)))
    return nvd.select(F.explode(products).alias("product"), "cve_id", versions.alias("versions"))


def version_pairs(index: DataFrame) -> DataFrame:
    """(product, version, cve_id) of every version that an index row lists."""
    return index.select("product", F.explode("versions").alias("_version"), "cve_id")


def unversioned(index: DataFrame) -> DataFrame:
    """(product, cve_id) of index rows that list no version, so that no version can confirm or refute them."""
    return index.where(F.coalesce(F.size("versions"), F.lit(0)) == 0).select("product", "cve_id")


def inline_matches(components: DataFrame, inline: DataFrame) -> DataFrame:
    """Matches stated in the document itself: (doc_id, ref, cve_id) against a component's ref.

    Of several components with one ref the last one is meant.
    """
    named = components.where(F.col("bom_ref").isNotNull())
    holder = named.groupBy("doc_id", "bom_ref").agg(
        F.max(F.struct("pos", "purl", "name")).alias("_c")
    )
    stated = inline.select("doc_id", F.col("ref").alias("bom_ref"), "cve_id").distinct()
    return stated.join(holder, ["doc_id", "bom_ref"]).select(
        "doc_id",
        F.coalesce(none_if_empty(F.col("_c.purl")), F.col("_c.name"), F.lit("")).alias("purl"),
        "cve_id",
        F.lit(INLINE).alias("match_method"),
        F.lit(INLINE_REASON).alias("match_reason"),
        F.lit(1).alias("tier"),
        F.col("_c.pos").alias("pos"),
    )


def with_lookup_keys(components: DataFrame) -> DataFrame:
    """``components`` with the lower-cased product and version (empty if unknown) that they are looked up by."""
    parts = compute_once(components, components.columns, purl_parts(F.col("purl")), "_u")
    version = F.coalesce(none_if_empty(F.col("_u.version")), none_if_empty(F.col("version")))
    return parts.select(
        *components.columns,
        F.lower(F.coalesce(none_if_empty(F.col("_u.name")), F.col("name"))).alias("_product"),
        F.coalesce(F.lower(version), F.lit("")).alias("_version"),
    )


def index_matches(components: DataFrame, index: DataFrame) -> DataFrame:
    """Matches by product name, confirmed or ruled out by version where both sides have one.

    Each distinct (name, version) is looked up once, in three parts: with a version by name and version at once and by
    name among entries without versions, without a version by name alone. A name whose versions don't fit yields no row
    on the way, so a product with very many vulnerabilities costs no more than its matches.
    """
    keyed = components if "_product" in components.columns else with_lookup_keys(components)
    wanted = keyed.select(
        "doc_id", "pos", F.coalesce("purl", F.lit("")).alias("purl"), F.col("_product").alias("product"), "_version"
    ).where(F.col("product") != "")
    asked = wanted.select("product", "_version").distinct()
    versioned, bare = asked.where("_version <> ''"), asked.where("_version = ''")
    parts = (
        (versioned.join(version_pairs(index).where("_version <> ''"), ["product", "_version"]), EXACT),
        (versioned.join(unversioned(index), "product"), NAME),
        (bare.join(index.select("product", "cve_id"), "product"), NAME),
    )
    found = [part.select("product", "_version", "cve_id", F.lit(method).alias("match_method")) for part, method in parts]
    resolved = reduce(DataFrame.unionByName, found).distinct()
    exact = F.format_string(EXACT_REASON, "product", "_version")
    by_name = F.format_string(NAME_REASON, "product")
    return wanted.join(resolved, ["product", "_version"]).select(
        "doc_id",
        "purl",
        "cve_id",
        "match_method",
        F.when(F.col("match_method") == EXACT, exact).otherwise(by_name).alias("match_reason"),
        F.lit(2).alias("tier"),
        "pos",
    )


def match_components(
    components: DataFrame, inline: DataFrame, index: DataFrame | None
) -> DataFrame:
    """One row per (document, purl, vulnerability): stated matches win, then component order.

    ``components``: doc_id, pos, purl, name, version, bom_ref. Without an index
    only the stated matches remain. Components are stored once, with what they are
    looked up by, and then read by each step, so a corpus is parsed once for them.
    """
    components = components.select("doc_id", "pos", "purl", "name", "version", "bom_ref")
    components = cut_lineage(components if index is None else with_lookup_keys(components))
    found = inline_matches(components, inline)
    if index is not None:
        found = found.unionByName(index_matches(components, index))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    best = keep_first(found, ["doc_id", "purl", "cve_id"], ["tier", "pos", "match_method"])
    return best.withColumn("match_confidence", confidence[F.col("match_method")]).select(*COLUMNS)
