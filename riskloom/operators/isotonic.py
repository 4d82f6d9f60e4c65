"""Isotonic regression over score ranges that are pooled apart and joined at their borders.

Neighbouring points whose means do not rise belong to one block of the fit, in whatever order they are pooled. So points are
numbered along the score and cut into ranges, each range is pooled by itself, and the blocks that are left are numbered and
cut anew, half a range further on, until no two neighbours fall. A task holds one range; the driver holds none.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.asof import asof_join
from riskloom.operators.ordering import number_all
from riskloom.session import cut_lineage

#: Points or blocks of one range.
RANGE = 200_000
BLOCK = "low double, high double, n long, positives long"
LARGEST = 1.7976931348623157e308


def _finite(score: str) -> Column:
    """The score as a double; infinite ones as the largest number there is, null for null and NaN."""
    p = F.col(score).cast("double")
    return F.when(p.isNotNull() & ~F.isnan(p), F.least(F.greatest(p, F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(0.0))


def pool(rows: Iterable[tuple[float, float, int, int]]) -> list[list]:
    """Blocks (low, high, n, positives) whose means rise strictly, of rows in order of the score; whole numbers throughout."""
    blocks: list[list] = []
    for low, high, n, positives in rows:
        while blocks and blocks[-1][3] * n >= positives * blocks[-1][2]:
            before = blocks.pop()
            low, n, positives = before[0], n + before[2], positives + before[3]
        blocks.append([low, high, n, positives])
    return blocks


def _pool_range(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("low")
    blocks = pool(zip(frame["low"].tolist(), frame["high"].tolist(), frame["n"].tolist(), frame["positives"].tolist()))
    return pd.DataFrame(blocks, columns=["low", "high", "n", "positives"])


def _falls(blocks: DataFrame) -> bool:
    """Whether any block, of those numbered by ``_place``, is no higher than the one before it."""
    after = blocks.select((F.col("_place") - 1).alias("_place"), F.col("n").alias("_n"), F.col("positives").alias("_p"))
    higher = F.col("_p").cast("decimal(38,0)") * F.col("n") <= F.col("positives").cast("decimal(38,0)") * F.col("_n")
    return not blocks.join(after, "_place").where(higher).isEmpty()


def isotonic_blocks(df: DataFrame, *, score: str, label: str, points: int = RANGE) -> DataFrame:
    """The non-decreasing fit of a 0/1 label to a score: ``low``, ``high``, ``n``, ``positives`` of each block.

    Rows are added up per distinct score before anything else; those with a null or NaN score or a null label don't count.
    Means of neighbouring blocks rise strictly. Of any size of range the blocks are the same; ``points`` bounds what one
    task holds. An empty table has no blocks.
    """
    rows = df.select(_finite(score).alias("low"), F.col(label).cast("long").alias("_y")).where("low is not null and _y is not null")
    sums = rows.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
    blocks = number_all(sums.select("low", F.col("low").alias("high"), "n", "positives"), [F.col("low")], "_place")
    shift = 0
    while True:
        ranges = blocks.withColumn("_range", F.floor((F.col("_place") + shift) / F.lit(points)))
        pooled = ranges.groupBy("_range").applyInPandas(_pool_range, BLOCK)
        blocks = cut_lineage(number_all(pooled, [F.col("low")], "_place"))
        if not _falls(blocks):
            return blocks.select("low", "high", "n", "positives")
        shift = points // 2 - shift


def isotonic_value(df: DataFrame, blocks: DataFrame, *, score: str, out: str) -> DataFrame:
    """``df`` with ``out``: the fit at each score, between two blocks on the line from one to the other.

    Scores outside the fitted ones take the nearest block's mean; null and NaN scores give null, as does a fit without
    blocks. Each distinct score meets its block once, in an as-of join.
    """
    mean = F.col("positives") / F.col("n")
    placed = number_all(blocks.select("low", "high", mean.alias("value")), [F.col("low")], "_place")
    first = placed.where("_place = 1").select(F.lit(-LARGEST).alias("_from"), F.col("low").alias("_high"), F.col("value").alias("_value"))
    steps = placed.select(F.col("low").alias("_from"), F.col("high").alias("_high"), F.col("value").alias("_value"), F.col("_place"))
    following = placed.select((F.col("_place") - 1).alias("_place"), F.col("low").alias("_next"), F.col("value").alias("_then"))
    known = steps.join(following, "_place", "left").drop("_place").unionByName(first, allowMissingColumns=True)
    asked = df.select(_finite(score).alias("_p")).where("_p is not null").distinct()
    found = asof_join(
        asked, known, on=[], left_time="_p", right_time="_from", values={c: c for c in ("_high", "_value", "_next", "_then")}
    )
    p = F.col("_p")
    between = F.col("_value") + (F.col("_then") - F.col("_value")) * (p - F.col("_high")) / (F.col("_next") - F.col("_high"))
    value: Column = F.when((p <= F.col("_high")) | F.col("_next").isNull(), F.col("_value")).otherwise(between)
    values = found.select(F.col("_p").alias("_asked"), value.alias("_fit"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(values, _finite(score) == F.col("_asked"), "left").select(*kept, F.col("_fit").alias(out))

