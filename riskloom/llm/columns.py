"""Column expressions the text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_between(text: Column, separators: str) -> Column:
    """The pieces of ``text`` between separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def text_key(text: Column) -> Column:
    """Tells apart rows that carry one id and different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def wide_hash(*parts: Column) -> Column:
    """128 bits of hash as two numbers, so that chance equality can be left out of account."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one, so that helper columns can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id and ``text_key`` are not among ``gone``; null ids are equal."""
    keyed = docs.select(packed(docs), F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"))
    drop = gone.select(F.col(id_col).alias("gone_doc"), F.col("text_key").alias("gone_key")).distinct()
    kept = keyed.join(drop, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("tkey") == F.col("gone_key")), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
