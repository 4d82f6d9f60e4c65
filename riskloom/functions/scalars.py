"""Small scalar helpers shared by features, labels and scoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """Wall-clock date of an ISO text; null when it does not start with a date.

    Only the first ten characters count, so no session time zone can move the day.
    """
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))


def clamp01(value: Column) -> Column:
    """Clamp to [0, 1]; null and NaN become 0."""
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    )


def lookup(value: Column, table: Mapping[str, int], default: int = 0) -> Column:
    """Literal-map lookup with a default for unknown and null values."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def has_text(value: Column, needle: str) -> Column:
    """1 when ``value`` contains ``needle``, else 0; null counts as empty."""
    return F.coalesce(F.contains(value, F.lit(needle)), F.lit(False)).cast("byte")


def list_size(value: Column) -> Column:
    """Array length with null as 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.size(value)).cast("int")


def iso_weekday(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(day) + 1).cast("int")


def unquote(text: Column) -> Column:
    """Percent-decode; a stray ``%`` and a plus sign stay as they are."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), text)
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def none_if_empty(value: Column) -> Column:
    """Empty text as null."""
    return F.nullif(value, F.lit(""))


def set_or_null(values: Column) -> Column:
    """Sorted distinct elements; an empty or null array gives null."""
    tidy = F.array_sort(F.array_distinct(values))
    return F.when(F.size(tidy) > 0, tidy)
