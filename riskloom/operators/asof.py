"""As-of joins: the latest right row at or before each left row's time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordering import as_number, slice_count, slice_edges, with_slice
from riskloom.session import cut_lineage

Fill = Mapping[str, object]


def _payload(right: DataFrame, time: str, values: Mapping[str, str], tie_break: Sequence[str]) -> Column:
    # Compared field by field: time first, then the declared tie-break, then the values.
    return F.struct(
        F.col(time).alias("_at"),
        *[F.col(name).alias(f"_tie{i}") for i, name in enumerate(tie_break)],
        *[F.col(source).alias(out) for out, source in values.items()],
    )


def _unpack(
    found: DataFrame, columns: Sequence[str], values: Mapping[str, str], fill: Fill, matched: str | None
) -> DataFrame:
    def one(out: str) -> Column:
        value = F.col("_best")[out]
        if out in fill:
            dtype = found.schema["_best"].dataType[out].dataType
            value = F.coalesce(value, F.lit(fill[out]).cast(dtype))
        return value.alias(out)

    extra = [F.col("_best")["_at"].alias(matched)] if matched else []
    return found.select(*columns, *[one(out) for out in values], *extra)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    values: Mapping[str, str],
    tie_break: Sequence[str] = (),
    fill: Fill | None = None,
    matched: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Every left row with ``values`` (output name to right column) as of its time.

    Works on distinct (key, time) points, so copies of a row cost nothing after
    the map side. Points are windowed per (key, time slice), and each slice
    starts from the last value of the slices before it; a key that holds a
    large share of all rows is spread over as many tasks as it spans slices.
    """
    keys = list(on)
    dtype = right.schema[right_time].dataType
    usable = right.where(F.col(right_time).isNotNull())
    marks = usable.select(
        *keys, F.col(right_time).alias("_t"), _payload(right, right_time, values, tie_break).alias("_best")
    )
    asked = left.where(F.col(left_time).isNotNull()).select(
        *keys,
        F.col(left_time).cast(dtype).alias("_t"),
        F.lit(None).cast(marks.schema["_best"].dataType).alias("_best"),
    )
    both = asked.unionByName(marks)
    wanted = slices if slices is not None else slice_count(left)
    # Stored once: the slice edges, the windows and what the slices carry over all read them.
    points = cut_lineage(both.groupBy(*keys, "_t").agg(F.max("_best").alias("_best"))).withColumn("_x", as_number(F.col("_t"), dtype))
    points = with_slice(points, "_x", slice_edges(points, "_x", wanted), "_slice")
    here = (
        Window.partitionBy(*keys, "_slice")
        .orderBy("_t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy(*keys, "_slice")
        .agg(F.max("_best").alias("_end"))
        .select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    )
    resolved = (
        points.select(*keys, "_slice", "_t", F.last("_best", ignorenulls=True).over(here).alias("_here"))
        .join(carried, [*keys, "_slice"])
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            "_t",
            F.coalesce("_here", "_carry").alias("_best"),
        )
        .where(F.col("_best").isNotNull())
    )
    match = F.col(left_time).cast(dtype) == F.col("_t")
    for i, key in enumerate(keys):
        match = match & (F.col(key) == F.col(f"_k{i}"))
    found = left.join(resolved, match, "left")
    return _unpack(found, left.columns, values, fill or {}, matched)


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    left_time: str,
    right_time: str,
    values: Mapping[str, str],
    tie_break: Sequence[str] = (),
    fill: Fill | None = None,
    matched: str | None = None,
    right_unique: bool = False,
) -> DataFrame:
    """As-of join for a left side with few times per key, such as a primary-keyed table.

    The distinct times of a key and its right rows are put in one order, along which the latest right row is carried
    forward: one sort and no joined pairs. Right rows are first reduced to one per (key, time) before they are shuffled
    on the key, so that a key has at most as many as there are times. ``right_unique`` says that the right side already
    is; it then meets the times in an equi-join, so that a table stored in buckets of the key stays where it is. Right
    rows later than every left row are not read.
    """
    last = left.agg(F.max(left_time)).scalar()
    point = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t")).where("_k is not null and _t is not null").distinct()
    history = right.where(F.col(right_time) <= last).select(
        F.col(on).alias("_k"),
        F.col(right_time).alias("_at"),
        _payload(right, right_time, values, tie_break).alias("_best"),
    )
    if right_unique:
        best = point.join(history, "_k").where(F.col("_at") <= F.col("_t")).groupBy("_k", "_t").agg(F.max("_best").alias("_best"))
    else:
        marks = history.where("_k is not null").groupBy("_k", "_at").agg(F.max("_best").alias("_best"))
        asked = point.select("_k", F.col("_t").alias("_at"), "_t")  # the union takes the wider type of both times
        upto = Window.partitionBy("_k").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        both = asked.unionByName(marks, allowMissingColumns=True).withColumn("_best", F.max("_best").over(upto))
        best = both.where("_t is not null and _best is not null").select("_k", "_t", "_best")
    found = left.join(best, (F.col(on) == F.col("_k")) & (F.col(left_time) == F.col("_t")), "left")
    return _unpack(found, left.columns, values, fill or {}, matched)


def value_if_known_by(
    value: Column, known_at: Column, when: Column, default: object = 0.0
) -> Column:
    """A row's own value when it was known at ``when``, else ``default``."""
    known = known_at.isNotNull() & (known_at <= when)
    return F.when(known, F.coalesce(value, F.lit(default))).otherwise(F.lit(default))
