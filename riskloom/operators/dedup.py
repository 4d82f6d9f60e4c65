"""Keep one row per key, chosen by a declared order.

``row_number() = 1`` lets Spark place a group limit before the shuffle, so a
key that holds a large share of all rows leaves each map task as one row.
The order must be total: add an id column to it when times can tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str | Column]


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hashed: bool = False) -> DataFrame:
    rows = df.withColumn("_hash", F.xxhash64(*keys)) if hashed else df
    rank = F.row_number().over(Window.partitionBy(*(["_hash"] if hashed else []), *keys).orderBy(*order))
    return rows.withColumn("_pick", rank).where("_pick = 1").select(*df.columns)


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def keep_first(df: DataFrame, keys: Sequence[str], order: Order, *, hashed: bool = False) -> DataFrame:
    """The first row of each key in ``order``.

    ``hashed`` sorts by a hash of the keys before the keys themselves. Texts that begin alike sort faster so, but a join
    on the keys that follows has to deal and sort the rows again.
    """
    return _pick(df, keys, [_column(item) for item in order], hashed)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, hashed: bool = False) -> DataFrame:
    """The last row of each key in ``order`` (column names, ascending); ``hashed`` as in ``keep_first``."""
    return _pick(df, keys, [F.col(name).desc() for name in order], hashed)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples."""
    return df.select(*keys).distinct()
