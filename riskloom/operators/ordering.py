"""Positions and running totals over an order that no single task has to hold.

A window over one group runs in one task. Where a group may hold a large share
of all rows, the order itself is split: into value slices with running totals
carried from slice to slice, or into range partitions with counted offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from riskloom.session import cut_lineage


def slice_count(df: DataFrame) -> int:
    """As many slices as the session has shuffle partitions, two at least."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def as_number(column: Column, dtype: DataType) -> Column:
    """A double that never decreases when ``column`` increases."""
    if isinstance(dtype, NumericType):
        return column.cast("double")
    if isinstance(dtype, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(dtype, TimestampType):
        return F.unix_seconds(column).cast("double")
    if isinstance(dtype, TimestampNTZType):
        day = F.unix_date(column.cast("date")).cast("double")
        return day * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.floor(F.second(column))
    raise TypeError(f"cannot slice by {dtype.simpleString()}")


def slice_edges(df: DataFrame, column: str, slices: int) -> list[float]:
    """Inner edges of about ``slices`` equally filled slices; only a sketch reaches the driver."""
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    found = df.approxQuantile(column, shares, 1.0 / (4 * slices))
    return sorted({edge for edge in found if edge == edge})


def with_slice(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Add the slice number of ``column``; larger values never get a smaller number."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    sliced = Bucketizer(
        inputCol=column, outputCol=out, splits=splits, handleInvalid="keep"
    ).transform(df)
    return sliced.withColumn(out, F.col(out).cast("int"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys appear once."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    match = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    )
    return left.join(renamed, match, how).drop(*[f"_right_{key}" for key in keys])


def running_totals(
    df: DataFrame,
    *,
    by: str,
    values: Sequence[str],
    groups: Sequence[str] = (),
    edges: Sequence[float] = (),
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<value>`` for each value: inclusive totals along numeric ``by``.

    ``df`` must hold one row per (group, ``by``). Each (group, slice) is a
    window of its own; what precedes it comes from the slices' own totals.
    """
    sliced = with_slice(df, by, edges, "_slice")
    order = F.col(by).desc() if descending else F.col(by).asc()
    slice_order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    here = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # At most one row per (group, slice).
    before = Window.partitionBy(*groups).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*groups, "_slice")
        .agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(
            *groups,
            "_slice",
            *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_pre_{v}") for v in values],
        )
    )
    local = sliced.select("*", *[F.sum(v).over(here).alias(f"_in_{v}") for v in values])
    return null_safe_join(local, carried, [*groups, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_in_{v}") + F.col(f"_pre_{v}")).alias(f"cum_{v}") for v in values],
    )


def number_all(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """1..n along ``order`` (total) over all rows, as BIGINT, from sorted range partitions with counted offsets."""
    # Row order within and across partitions is fixed by the checkpoint, so the
    # numbers and the offsets counted from them cannot drift apart on a retry.
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_slot", 33))
    # One row per partition.
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_lo"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_slot") - F.col("_lo") + F.col("_before") + 1).alias(out)
    )


def number_in_groups(
    df: DataFrame, order: Sequence[Column], *, groups: Sequence[str], slice_of: Column, out: str = "position"
) -> DataFrame:
    """1..n along ``order`` (total) within each group, as BIGINT; null groups count like others.

    ``slice_of`` is a whole number that never falls along the order. Each
    (group, slice) is numbered by itself and starts from the counts of the
    slices before it, so a group with a large share of all rows is spread over
    as many tasks as it spans slices.
    """
    rows = cut_lineage(df.withColumn("_slice", slice_of))
    here = Window.partitionBy(*groups, "_slice").orderBy(*order)
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_here", F.row_number().over(here).cast("long"))
    return null_safe_join(numbered, starts, [*groups, "_slice"]).select(
        *df.columns, (F.col("_here") + F.col("_before")).alias(out)
    )


def number_along(df: DataFrame, order: Sequence[Column], *, groups: Sequence[str], out: str = "position", slices: int | None = None) -> DataFrame:
    """1..n along ``order`` (total) within each group, as BIGINT; null groups count like others.

    Rows are dealt by ranges of the group and the whole order, so that a group with a large share of all rows is spread
    over many tasks even where its leading values are equal. Within a range rows are numbered as they are stored, and each
    range starts from the counts of the group in the ranges before it. ``slices`` is the number of ranges, if it is given.
    """
    along = [*[F.col(g).asc() for g in groups], *order]
    ranged = df.repartitionByRange(*along) if slices is None else df.repartitionByRange(slices, *along)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*along).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_slot", 33))
    # One row per group and range.
    parts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_lo"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*groups, "_part", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return null_safe_join(placed, starts, [*groups, "_part"]).select(
        *df.columns, (F.col("_slot") - F.col("_lo") + F.col("_before") + 1).alias(out)
    )


def order_statistic(df: DataFrame, place: int, order: Sequence[str]) -> Row | None:
    """The row number ``place`` (from 1) along the columns of ``order``, nulls first; ``None`` beyond the last row.

    Rows are counted per value of the first column; only those of the value that holds the place go on to the next
    column. So no more is sorted than the rows that share all leading values.
    """
    first, rest = order[0], order[1:]
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    numbered = cut_lineage(number_all(counts, [F.col(first).asc()], "_place"))
    # Running totals over ranges of the numbers, whose sums are carried from range to range.
    ranged = numbered.withColumn("_range", F.floor(F.col("_place") / 100_000))
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.join(carried, "_range").withColumn("_upto", F.col("_before") + F.sum("_n").over(here))
    held = totals.where(F.col("_upto") >= place).agg(F.min_by(F.struct(first, "_n", "_upto"), "_upto").alias("_v")).first()["_v"]
    if held is None:
        return None
    value, count, upto = held
    if not rest or count == 1:
        own = df.where(F.col(first).eqNullSafe(F.lit(value).cast(df.schema[first].dataType)))
        return own.select(*order).first()
    inside = df.where(F.col(first).eqNullSafe(F.lit(value).cast(df.schema[first].dataType)))
    later = order_statistic(inside.select(*rest), place - (upto - count), rest)
    return Row(**{first: value, **later.asDict()})


def at_or_before(bound: Row, order: Sequence[str], schema: StructType) -> Column:
    """Whether a row's columns of ``order`` come no later than ``bound``'s, nulls first."""
    name = order[0]
    value, column = bound[name], F.col(name)
    same = column.eqNullSafe(F.lit(value).cast(schema[name].dataType))
    less = F.lit(False) if value is None else column.isNull() | (column < F.lit(value).cast(schema[name].dataType))
    less = F.coalesce(less, F.lit(False))
    return less | (same & at_or_before(bound, order[1:], schema)) if len(order) > 1 else less | same
