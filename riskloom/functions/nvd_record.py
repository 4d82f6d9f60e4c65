"""Column expressions over one parsed vulnerability record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.identifiers import cpe_parts
from riskloom.functions.scalars import none_if_empty, set_or_null

_CVSS_DATA = "struct<baseScore:string,baseSeverity:string,vectorString:string>"
# The second data key is a misspelling that some producers emit; it wins when present.
_CVSS = f"array<struct<type:string,cvssData:{_CVSS_DATA},cssvData:{_CVSS_DATA}>>"
_FIELDS = {
    "id": "string",
    "published": "string",
    "lastModified": "string",
    "descriptions": "array<struct<lang:string,value:string>>",
    "metrics": f"struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS}>",
    "weaknesses": "array<struct<description:array<struct<value:string>>>>",
    "configurations": "array<struct<nodes:array<struct<cpeMatch:"
    "array<struct<criteria:string,cpe23Uri:string>>>>>>",
    "references": "array<struct<tags:array<string>>>",
}
_BARE = ",".join(f"{name}:{dtype}" for name, dtype in _FIELDS.items())
# A record may be wrapped in ``cve`` or bare.
RECORD_TYPE = f"struct<cve:struct<{_BARE}>,{_BARE}>"


def unwrapped(parsed: Column) -> Column:
    """The record itself, whether or not it came wrapped in ``cve``."""
    return F.coalesce(parsed["cve"], F.struct(*[parsed[name].alias(name) for name in _FIELDS]))


def _joined(lists: Column) -> Column:
    return F.flatten(F.filter(lists, lambda part: part.isNotNull()))


def _score(entries: Column) -> Column:
    primary = F.get(F.filter(entries, lambda e: e["type"] == "Primary"), F.lit(0))
    entry = F.coalesce(primary, F.get(entries, F.lit(0)))
    odd = entry["cssvData"]
    used = F.coalesce(odd["baseScore"], odd["baseSeverity"], odd["vectorString"]).isNotNull()
    data = F.when(used, odd).otherwise(entry["cvssData"])
    return F.when(
        entry.isNotNull(),
        F.struct(
            data["baseScore"].try_cast("float").alias("base"),
            F.upper(none_if_empty(data["baseSeverity"])).alias("severity"),
            none_if_empty(data["vectorString"]).alias("vector"),
        ),
    )


def cvss_v3(metrics: Column) -> Column:
    """Version 3.1 when it carries a base score, else 3.0 when listed, else what 3.1 has."""
    newer, older = _score(metrics["cvssMetricV31"]), _score(metrics["cvssMetricV30"])
    return F.when(newer["base"].isNotNull(), newer).when(older.isNotNull(), older).otherwise(newer)


def cpe_list(configurations: Column) -> Column:
    """All ``struct(vendor, product, version)`` below a record's configurations."""
    nodes = _joined(F.transform(configurations, lambda c: c["nodes"]))
    hits = _joined(F.transform(nodes, lambda n: n["cpeMatch"]))
    return F.transform(
        hits, lambda m: cpe_parts(F.coalesce(none_if_empty(m["criteria"]), m["cpe23Uri"]))
    )


def field_set(structs: Column, field: str) -> Column:
    """Sorted distinct non-null values of one struct field; null when there are none."""
    return set_or_null(F.filter(F.transform(structs, lambda s: s[field]), lambda v: v.isNotNull()))


def tagged(references: Column, tag: str) -> Column:
    """Whether any reference carries the tag, ignoring case."""
    hit = F.exists(
        references,
        lambda r: F.coalesce(F.exists(r["tags"], lambda t: F.lower(t) == tag), F.lit(False)),
    )
    return F.coalesce(hit, F.lit(False))


def english_text(descriptions: Column) -> Column:
    """First English description, empty when there is none."""
    first = F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))
    return F.coalesce(first["value"], F.lit(""))


def cwe_set(weaknesses: Column) -> Column:
    """Sorted distinct ``CWE-`` values over all weakness descriptions; null when none."""
    values = F.transform(
        _joined(F.transform(weaknesses, lambda w: w["description"])), lambda d: d["value"]
    )
    return set_or_null(F.filter(values, lambda v: F.startswith(v, F.lit("CWE-"))))
