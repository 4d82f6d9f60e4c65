"""Software inventories: parsing, matching, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.match import (
    EXACT,
    EXACT_REASON,
    INLINE,
    INLINE_REASON,
    NAME_REASON,
    inline_matches,
    match_components,
    product_index,
)
from riskloom.operators.score import rank_matches, score_ids
from riskloom.plans.ranking import rank_documents
from riskloom.session import spread
from riskloom.sources.sbom import parse_documents
from workloads import derived
from workloads.registry import query, table

# An order is a document with three components. Names lie on multiples of three,
# so a product matches at most three vulnerabilities whatever the scale.
_NAME0 = "'prod' || CAST(o_custkey - o_custkey % 3 AS VARCHAR)"
_NAME1 = "'Prod' || CAST(o_custkey + 3 - o_custkey % 3 AS VARCHAR)"
_NAME2 = "'prod' || CAST(2 * o_custkey - (2 * o_custkey) % 3 AS VARCHAR)"
_VER0 = "CAST(o_orderkey % 5 AS VARCHAR) || '.0'"
_VER1 = "CAST(o_orderkey % 3 AS VARCHAR) || '.0'"
_REASON = """CASE WHEN o_orderkey % 10 = 2 THEN 'not a JSON object'
  WHEN o_orderkey % 10 = 0 THEN 'bomFormat is not CycloneDX' WHEN o_orderkey % 10 = 1 THEN 'specVersion is missing'
  WHEN o_orderkey % 10 = 3 AND o_orderstatus = 'P' THEN 'components is not a list' END"""

COMPONENTS = f"""
docs AS (SELECT * FROM orders WHERE ({_REASON}) IS NULL),
components AS (
  SELECT o_orderkey AS doc_id, 0 AS pos, 'pkg:generic/' || {_NAME0} || '@' || {_VER0} AS purl, 'x' AS name,
    {_VER0} AS version, 'library' AS type, 'ref-0' AS bom_ref, {_NAME0} AS product FROM docs
  UNION ALL
  SELECT o_orderkey, 1, 'pkg:generic/' || {_NAME1} || '@' || {_VER1}, {_NAME1}, {_VER1}, 'application',
    'pkg:generic/' || {_NAME1} || '@' || {_VER1}, lower({_NAME1}) FROM docs
  UNION ALL
  SELECT o_orderkey, 2, 'pkg:npm/' || {_NAME2}, {_NAME2}, NULL, 'library', 'pkg:npm/' || {_NAME2}, {_NAME2} FROM docs),
inline AS (
  SELECT o_orderkey AS doc_id, r.ref, {derived.cve_sql("CVE-2023-", "o_custkey")} AS cve_id
  FROM docs, (VALUES (0), (1)) v(i),
    LATERAL (SELECT CASE WHEN v.i = 0 THEN 'ref-0' ELSE 'pkg:generic/' || {_NAME1} || '@' || {_VER1} END AS ref) r
  WHERE o_orderkey % 3 = 0)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One inventory document per order, some of them unusable."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def name(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    name0 = name("prod", cust - cust % 3)
    name1 = name("Prod", cust + 3 - cust % 3)
    name2 = name("prod", 2 * cust - (2 * cust) % 3)
    ver0 = F.concat((key % 5).cast("string"), F.lit(".0"))
    ver1 = F.concat((key % 3).cast("string"), F.lit(".0"))
    none = F.lit(None).cast("string")

    def entry(ref: Column, label: Column, version: Column, kind: Column, purl: Column) -> Column:
        return F.struct(
            ref.alias("bom-ref"), label.alias("name"), version.alias("version"), kind.alias("type"), purl.alias("purl")
        )

    generic0 = F.concat(F.lit("pkg:generic/"), name0, F.lit("@"), ver0)
    generic1 = F.concat(F.lit("pkg:generic/"), name1, F.lit("@"), ver1)
    listed = F.array(
        entry(F.lit("ref-0"), F.lit("x"), ver0, F.lit("library"), generic0),
        entry(none, name1, ver1, F.lit("application"), none),
        entry(F.concat(F.lit("pkg:npm/"), name2), name2, none, none, none),
    )
    stated = F.struct(
        F.concat(F.lit("ref cve-2023-"), F.lpad(cust.cast("string"), 12, "0"), F.lit(" etc")).alias("id"),
        F.array(F.struct(F.lit("ref-0").alias("ref")), F.struct(generic1.alias("ref"))).alias("affects"),
    )
    body = F.to_json(
        F.struct(
            F.when(key % 10 == 0, "SPDX").otherwise("CycloneDX").alias("bomFormat"),
            F.when(key % 10 != 1, "1.5").alias("specVersion"),
            F.when((key % 10 != 3) | (F.col("o_orderstatus") != "P"), listed).alias("components"),
            F.when(key % 3 == 0, F.array(stated)).alias("vulnerabilities"),
        )
    )
    spoiled = F.regexp_replace(body, r"\}$", ',"components":{"a":1}}')
    text = (
        F.when(key % 10 == 2, "no document")
        .when((key % 10 == 3) & (F.col("o_orderstatus") == "P"), spoiled)
        .otherwise(body)
    )
    return spread(table(spark, folder, "orders")).select(key.alias("doc_id"), text.alias("json"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as vulnerabilities with products and versions."""
    key = F.col("p_partkey")
    product = F.concat(F.lit("PROD"), (key - key % 3).cast("string"))
    versions = F.array(
        F.concat((key % 5).cast("string"), F.lit(".0")), F.concat((key % 2).cast("string"), F.lit(".0"))
    )
    return table(spark, folder, "part").select(
        derived.cve("CVE-2023-", "p_partkey").alias("cve_id"),
        F.when(key % 11 != 0, F.array(product, F.lower(product))).alias("products"),
        F.when(key % 4 != 0, versions).alias("versions"),
    )


INDEX = f"""
idx AS (SELECT {derived.cve_sql("CVE-2023-", "p_partkey")} AS cve_id,
    'prod' || CAST(p_partkey - p_partkey % 3 AS VARCHAR) AS product,
    CASE WHEN p_partkey % 4 <> 0 THEN [CAST(p_partkey % 5 AS VARCHAR) || '.0', CAST(p_partkey % 2 AS VARCHAR) || '.0'] END
      AS versions
  FROM part WHERE p_partkey % 11 <> 0)"""

MATCHES = """
hits AS (
  SELECT i.doc_id, c.purl, i.cve_id, 'inline_vex' AS match_method, 1 AS tier, c.pos, '' AS product, '' AS version
  FROM (SELECT DISTINCT * FROM inline) i JOIN (
    SELECT doc_id, bom_ref, max(pos) AS pos, arg_max(purl, pos) AS purl FROM components GROUP BY doc_id, bom_ref
  ) c ON c.doc_id = i.doc_id AND c.bom_ref = i.ref
  UNION ALL
  SELECT c.doc_id, c.purl, x.cve_id,
    CASE WHEN c.version IS NOT NULL AND x.versions IS NOT NULL THEN 'product_version_exact' ELSE 'product_name' END,
    2, c.pos, c.product, c.version
  FROM components c JOIN idx x ON x.product = c.product
  WHERE c.version IS NULL OR x.versions IS NULL OR list_contains(x.versions, c.version)),
matches AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, purl, cve_id ORDER BY tier, pos) AS rn FROM hits)
  WHERE rn = 1)"""


@query(f"WITH {COMPONENTS} SELECT doc_id, pos, purl, name, version, type, bom_ref FROM components")
def sbom_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the usable documents."""
    return parse_documents(documents(spark, folder)).components


@query(f"SELECT o_orderkey AS doc_id, {_REASON} AS reason FROM orders WHERE ({_REASON}) IS NOT NULL")
def sbom_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Unusable documents with the reason."""
    return parse_documents(documents(spark, folder)).rejects


@query(
    f"""WITH {COMPONENTS}, {INDEX}, {MATCHES}
    SELECT doc_id, purl, cve_id, pos FROM matches WHERE tier = 1"""
)
def inline_match(spark: SparkSession, folder: str) -> DataFrame:
    """Matches stated in the documents."""
    made = parse_documents(documents(spark, folder))
    return inline_matches(made.components, made.inline).select("doc_id", "purl", "cve_id", "pos")


@query(f"WITH {INDEX} SELECT product, cve_id, array_to_string(versions, '|') AS versions FROM idx")
def product_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The product index: lower-cased, one row per (product, vulnerability)."""
    return product_index(products(spark, folder)).withColumn("versions", F.array_join("versions", "|"))


_REASONS = f"""CASE match_method WHEN '{INLINE}' THEN '{INLINE_REASON}'
  WHEN '{EXACT}' THEN printf('{EXACT_REASON.replace("'", "''")}', product, version)
  ELSE printf('{NAME_REASON.replace("'", "''")}', product) END AS match_reason"""
_CONFIDENCE = """CASE match_method WHEN 'inline_vex' THEN 'high' WHEN 'product_version_exact' THEN 'medium'
  ELSE 'low' END AS match_confidence"""


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    made = parse_documents(documents(spark, folder))
    return match_components(made.components, made.inline, product_index(products(spark, folder)))


@query(
    f"""WITH {COMPONENTS}, {INDEX}, {MATCHES}
    SELECT doc_id, purl, cve_id, match_method, {_CONFIDENCE}, {_REASONS}, tier, pos FROM matches"""
)
def component_match(spark: SparkSession, folder: str) -> DataFrame:
    """Tiered matches of every component."""
    return _matches(spark, folder)


def _part_master(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").where(key % 6 != 5).select(
        derived.cve("CVE-2023-", "p_partkey").alias("cve_id"),
        F.when(key % 4 != 1, ((key % 7).cast("double") / 10).cast("float")).alias("epss_score"),
        F.when(key % 4 != 1, ((key % 9).cast("double") / 8).cast("float")).alias("epss_percentile"),
        (key % 13 == 0).alias("in_kev"),
        F.when(key % 3 != 0, (F.col("p_size").cast("double") / 5).cast("float")).alias("cvss_v3_base_score"),
    )


def _part_predictions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").where(key % 3 == 1).select(
        derived.cve("CVE-2023-", "p_partkey").alias("cve_id"),
        ((key % 11).cast("double") / 8 - 0.5).alias("predicted"),
    )


_PART_MASTER = f"""
pm AS (
  SELECT {derived.cve_sql("CVE-2023-", "p_partkey")} AS cve_id, TRUE AS known,
    CASE WHEN p_partkey % 4 <> 1 THEN CAST(CAST(p_partkey % 7 AS DOUBLE) / 10 AS FLOAT) END AS s,
    CASE WHEN p_partkey % 4 <> 1 THEN CAST(CAST(p_partkey % 9 AS DOUBLE) / 8 AS FLOAT) END AS q,
    p_partkey % 13 = 0 AS in_kev,
    CASE WHEN p_partkey % 3 <> 0 THEN CAST(CAST(p_size AS DOUBLE) / 5 AS FLOAT) END AS cvss
  FROM part WHERE p_partkey % 6 <> 5),
pp AS (
  SELECT {derived.cve_sql("CVE-2023-", "p_partkey")} AS cve_id, CAST(p_partkey % 11 AS DOUBLE) / 8 - 0.5 AS predicted
  FROM part WHERE p_partkey % 3 = 1)"""
_PROBABILITY = """round(CASE WHEN pp.predicted IS NOT NULL
  THEN least(1.0, greatest(0.0, coalesce(CAST(pm.s AS DOUBLE), 0.0) + pp.predicted))
  WHEN pm.known THEN coalesce(CAST(pm.s AS DOUBLE), 0.0) ELSE 0.0 END, 9)"""
_SCORED = f"""{_PROBABILITY} AS probability,
  least(1.0, coalesce(CAST(pm.q AS DOUBLE), 0.0)) AS percentile, coalesce(pm.in_kev, FALSE) AS in_kev,
  CAST(pm.cvss AS DOUBLE) AS cvss_v3_base_score"""


@query(
    f"""WITH {_PART_MASTER}
    SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, {_SCORED}
    FROM lineitem l
    LEFT JOIN pm ON pm.cve_id = {derived.cve_sql("CVE-2023-", "l.l_partkey + l.l_linenumber")}
    LEFT JOIN pp ON pp.cve_id = {derived.cve_sql("CVE-2023-", "l.l_partkey + l.l_linenumber")}"""
)
def blend_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores for every requested id, duplicates and unknown ids included."""
    lines = table(spark, folder, "lineitem").withColumn("_n", F.col("l_partkey") + F.col("l_linenumber"))
    requests = lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", derived.cve("CVE-2023-", "_n").alias("cve_id")
    )
    made = score_ids(requests, _part_master(spark, folder), _part_predictions(spark, folder))
    return made.withColumn("probability", F.round("probability", 9)).drop("cve_id")


@query(
    f"""WITH {_PART_MASTER}
    SELECT p_partkey, round(CASE WHEN pp.predicted IS NOT NULL THEN least(1.0, greatest(0.0, pp.predicted))
      WHEN pm.known THEN coalesce(CAST(pm.s AS DOUBLE), 0.0) ELSE 0.0 END, 9) AS probability
    FROM part LEFT JOIN pm ON pm.cve_id = {derived.cve_sql("CVE-2023-", "p_partkey")}
    LEFT JOIN pp ON pp.cve_id = {derived.cve_sql("CVE-2023-", "p_partkey")}"""
)
def classifier_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with a model that predicts probabilities: the baseline is not added again."""
    requests = table(spark, folder, "part").select(
        "p_partkey", derived.cve("CVE-2023-", "p_partkey").alias("cve_id")
    )
    made = score_ids(
        requests, _part_master(spark, folder), _part_predictions(spark, folder), kind="probability"
    )
    return made.select("p_partkey", F.round("probability", 9).alias("probability"))


@query(
    """
    SELECT doc_id, cve_id, pos, line, row_number() OVER (PARTITION BY doc_id
      ORDER BY probability DESC, coalesce(cvss, 0) DESC, cve_id, pos, line) AS rank
    FROM (SELECT l_orderkey AS doc_id, 'C' || CAST(l_partkey % 50 AS VARCHAR) AS cve_id, l_linenumber AS pos,
      l_suppkey * 100000000 + l_partkey AS line,
      l_discount AS probability, CASE WHEN l_tax > 0.02 THEN l_tax END AS cvss
      FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem))
    """
)
def rank_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ranked within their order by score, base score and id."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("cve_id"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_suppkey") * 100000000 + F.col("l_partkey")).alias("line"),
        F.col("l_discount").alias("probability"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("cvss_v3_base_score"),
        "l_tax",
    )
    distinct = lines.distinct().drop("l_tax")
    ranked = rank_matches(distinct, ties=("pos", "line"))
    return ranked.select("doc_id", "cve_id", "pos", "line", "rank")


@query(
    f"""WITH {COMPONENTS}, {INDEX}, {MATCHES}, {_PART_MASTER},
    scored AS (SELECT m.*, {_SCORED} FROM matches m LEFT JOIN pm ON pm.cve_id = m.cve_id
      LEFT JOIN pp ON pp.cve_id = m.cve_id)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id
        ORDER BY probability DESC, coalesce(cvss_v3_base_score, 0) DESC, cve_id, tier, pos) AS rank,
      cve_id, purl, probability, percentile, cvss_v3_base_score, in_kev, match_method, {_CONFIDENCE}
    FROM scored"""
)
def rank_inventories(spark: SparkSession, folder: str) -> DataFrame:
    """Every document parsed, matched, scored and ranked in one job."""
    ranked = rank_documents(
        documents(spark, folder),
        _part_master(spark, folder),
        index=product_index(products(spark, folder)),
        predictions=_part_predictions(spark, folder),
    ).ranked
    return ranked.drop("match_reason").withColumn("probability", F.round("probability", 9))


@query(
    f"""WITH {COMPONENTS}, {INDEX}, {MATCHES}
    SELECT doc_id, purl, cve_id, 'inline_vex' AS match_method FROM matches WHERE tier = 1"""
)
def match_without_index(spark: SparkSession, folder: str) -> DataFrame:
    """With no product index only the stated matches remain."""
    made = parse_documents(documents(spark, folder))
    return match_components(made.components, made.inline, None).select(
        "doc_id", "purl", "cve_id", "match_method"
    )
