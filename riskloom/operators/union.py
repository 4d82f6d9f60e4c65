"""Vertical union of tables whose column types differ in width."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_relaxed(frames: Sequence[DataFrame], *, allow_missing: bool = False) -> DataFrame:
    """Rows of all frames by column name, each column in the widest of its types."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
