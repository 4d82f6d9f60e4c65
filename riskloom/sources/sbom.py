"""CycloneDX documents, one JSON text per row, to components and stated matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.identifiers import component_purl, cve_id_in
from riskloom.functions.scalars import none_if_empty
from riskloom.operators.once import compute_once
from riskloom.session import cut_lineage, spread

_ENVELOPE = "bomFormat string, specVersion string, components string, vulnerabilities string, _broken string"
_COMPONENT = "struct<type:string,`bom-ref`:string,name:string,version:string,purl:string>"
_VULNERABILITY = "struct<id:string,affects:array<string>>"
# JSON texts that count as an absent list.
_ABSENT = ["", "null", "false", "0", "{}", "[]", '""']


@dataclass(frozen=True)
class Inventory:
    """Components, stated (doc_id, ref, cve_id) rows, and rejected documents with a reason."""

    components: DataFrame
    inline: DataFrame
    rejects: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: doc_id (the file name) and its text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json")
    )


def parse_documents(documents: DataFrame, *, doc: str = "doc_id", text: str = "json") -> Inventory:
    """Split documents into components and stated matches; bad ones go to ``rejects``."""
    body = F.trim(text)
    opening = F.struct(
        (F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))).alias("_object"),
        F.from_json(text, _ENVELOPE, {"columnNameOfCorruptRecord": "_broken"}).alias("_d"),
    )
    named = spread(documents.select(F.col(doc).alias("doc_id"), F.col(text)))
    opened = compute_once(named, ["doc_id"], opening, "_o").select("doc_id", "_o._object", "_o._d.*")
    listed = F.coalesce(F.startswith(F.trim("components"), F.lit("[")), F.lit(False))
    absent = F.col("components").isNull() | F.trim("components").isin(_ABSENT)
    version = F.nullif(none_if_empty(F.col("specVersion")), F.lit("0"))
    reason = (
        F.when(~F.coalesce("_object", F.lit(False)), "not a JSON object")
        .when(F.col("_broken").isNotNull(), "invalid JSON")
        .when(~F.col("bomFormat").eqNullSafe(F.lit("CycloneDX")), "bomFormat is not CycloneDX")
        .when(version.isNull(), "specVersion is missing")
        .when(~listed & ~absent, "components is not a list")
    )
    judged = opened.withColumn("reason", reason)
    # Elements stay text until they are rows, so one odd element cannot spoil its list. They are stored once, as rows of
    # all kinds, so that components, stated matches and rejects come from one pass over the documents.
    element = "array<struct<kind:string,pos:int,text:string>>"

    def listed_as(kind: str, column: str) -> Column:
        texts = F.from_json(column, "array<string>")
        rows = F.transform(texts, lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), e.alias("text")))
        return F.coalesce(rows.cast(element), F.array().cast(element))

    refused = F.array(F.struct(F.lit("reject").alias("kind"), F.lit(0).alias("pos"), F.col("reason").alias("text"))).cast(element)
    every = F.when(F.col("reason").isNotNull(), refused).otherwise(F.concat(listed_as("component", "components"), listed_as("finding", "vulnerabilities")))
    elements = cut_lineage(judged.select("doc_id", F.explode(every).alias("_x")).select("doc_id", "_x.*"))

    def of_kind(kind: str) -> DataFrame:
        return elements.where(F.col("kind") == kind).select("doc_id", "pos", F.col("text").alias("_e"))

    objects = of_kind("component").where(F.startswith(F.trim("_e"), F.lit("{")))
    parsed = compute_once(objects, ["doc_id", "pos"], F.from_json("_e", _COMPONENT), "_c")
    entry = parsed.select(
        "doc_id",
        "pos",
        component_purl(
            F.col("_c.purl"), F.col("_c.bom-ref"), F.col("_c.name"), F.col("_c.version")
        ).alias("purl"),
        F.col("_c.name").alias("name"),
        F.col("_c.version").alias("version"),
        F.coalesce(none_if_empty(F.col("_c.type")), F.lit("library")).alias("type"),
        none_if_empty(F.col("_c.bom-ref")).alias("_ref"),
    )
    components = entry.withColumn("bom_ref", F.coalesce("_ref", "purl")).drop("_ref")
    findings = compute_once(of_kind("finding"), ["doc_id"], F.from_json("_e", _VULNERABILITY), "_v")
    affected = findings.select(
        "doc_id", cve_id_in(F.col("_v.id")).alias("cve_id"), F.explode("_v.affects").alias("_a")
    )
    stated = compute_once(
        affected, ["doc_id", "cve_id"], F.from_json("_a", "ref string")["ref"], "ref"
    ).where("cve_id is not null and ref is not null")
    return Inventory(components, stated, of_kind("reject").select("doc_id", F.col("_e").alias("reason")))
