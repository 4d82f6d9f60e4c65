"""Evaluate a costly expression once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: Sequence[str], expression: Column, out: str) -> DataFrame:
    """The kept columns and ``expression`` as ``out``.

    A filter on a projected column is pushed below the projection together with
    a copy of the column's expression, so a parsed document would be parsed
    again for every filter on it. Nothing is copied out of a generator.
    """
    return df.select(*keep, F.explode(F.array(expression)).alias(out))
