"""CVE ids, CPE names and package URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import none_if_empty, unquote

# The id formats the feeds use.
CVE_ANYWHERE = r"CVE-\d{4}-\d{4,}"
CVE_EXACT = r"^CVE-\d{4}-\d{4,}$"
CWE_EXACT = r"^CWE-\d+$"
# Fixed value: pkg:type/path[@version][?qualifiers][#subpath].
PURL = r"^pkg:([^/]+)/([^@?#]+)(?:@([^?#]+))?(?:\?[^#]*)?(?:#.*)?$"
# CPE version fields that mean "any" or "not applicable".
CPE_NO_VERSION = ["", "*", "-"]


def cve_id_in(text: Column) -> Column:
    """First CVE id anywhere in the text, upper-cased; null when there is none."""
    return none_if_empty(F.regexp_extract(F.upper(text), CVE_ANYWHERE, 0))


def cpe_parts(uri: Column) -> Column:
    """``struct(vendor, product, version)`` of a CPE 2.3 name; all null when malformed."""
    parts = F.split(uri, ":")
    valid = (F.size(parts) >= 5) & (F.get(parts, F.lit(0)) == "cpe")
    version = F.get(parts, F.lit(5))
    return F.struct(
        F.when(valid, none_if_empty(F.get(parts, F.lit(3)))).alias("vendor"),
        F.when(valid, none_if_empty(F.get(parts, F.lit(4)))).alias("product"),
        F.when(valid & ~version.isin(CPE_NO_VERSION), version).alias("version"),
    )


def purl_parts(purl: Column) -> Column:
    """``struct(type, namespace, name, version)`` of a package URL; all null when malformed."""
    raw_version = none_if_empty(F.regexp_extract(purl, PURL, 3))
    segments = F.filter(F.split(F.regexp_extract(purl, PURL, 2), "/"), lambda s: s != "")
    count = F.size(segments)
    name = F.get(segments, count - 1)
    spaces = F.transform(F.slice(segments, 1, F.greatest(count - 1, F.lit(0))), unquote)
    return F.struct(
        none_if_empty(F.regexp_extract(purl, PURL, 1)).alias("type"),
        F.when(count > 1, F.array_join(spaces, "/")).alias("namespace"),
        unquote(name).alias("name"),
        F.when(count > 0, unquote(raw_version)).otherwise(raw_version).alias("version"),
    )


def component_purl(purl: Column, bom_ref: Column, name: Column, version: Column) -> Column:
    """Explicit purl, else a ``pkg:`` bom-ref, else a generic purl from name and version."""
    generic = F.concat(
        F.lit("pkg:generic/"),
        none_if_empty(name),
        F.coalesce(F.concat(F.lit("@"), none_if_empty(version)), F.lit("")),
    )
    return F.coalesce(
        none_if_empty(purl),
        F.when(F.startswith(bom_ref, F.lit("pkg:")), bom_ref),
        generic,
    )
