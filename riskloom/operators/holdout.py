"""Rolling holdout, its fingerprint, and the training rows left beside it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordering import at_or_before, order_statistic

# Hex digits of the key digest that name a block, one entry per level.
BLOCK_DIGITS = (6, 3, 0)
# The hashed text's first line and the reported reasons.
HASH_HEADER = "cve_id,published_date,exploited_30d"
EMPTY_REASON = "no closed-window rows available after right-censoring"
SPARSE_REASON = (
    "no rolling holdout window met minimums (need >= %d rows and >= %d positives; "
    "best attempt was last %dd with n=%d, positives=%d)"
)


@dataclass(frozen=True)
class HoldoutConfig:
    """Window length and the least content a window needs."""

    holdout_days: int = 90
    min_rows: int = 50
    min_positives: int = 1
    min_holdout_days: int = 14

    def candidate_days(self) -> list[int]:
        """Lengths to try, longest first: halved each time, never below the minimum."""
        days = [self.holdout_days]
        while days[-1] > self.min_holdout_days:
            days.append(max(self.min_holdout_days, days[-1] // 2))
        return days


@dataclass(frozen=True)
class Holdout:
    """The selected window, or the reason why there is none."""

    start: date | None
    end: date | None
    window_days: int | None
    n_rows: int
    n_positives: int
    reason: str | None

    @property
    def found(self) -> bool:
        return self.start is not None


def holdout_candidates(
    rows: DataFrame,
    config: HoldoutConfig = HoldoutConfig(),
    *,
    day: str = "published_date",
    label: str = "exploited_30d",
) -> DataFrame:
    """One row per candidate length, all ending on the latest day; empty for no rows.

    Rows are counted per day first, so every window is a sum over days.
    """
    daily = rows.groupBy(F.col(day).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_pos")
    )

    def total(column: str, start: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_day") >= start, F.col(column))), F.lit(0))

    windows = [
        F.struct(
            F.lit(days).alias("window_days"),
            F.date_sub(F.max("_end"), days - 1).alias("start"),
            F.max("_end").alias("end"),
            total("_n", F.date_sub(F.col("_end"), days - 1)).alias("n_rows"),
            total("_pos", F.date_sub(F.col("_end"), days - 1)).alias("n_positives"),
        )
        for days in config.candidate_days()
    ]
    # One row per day, so a window over all of them is small.
    latest = F.max("_day").over(Window.partitionBy())
    counted = daily.withColumn("_end", latest).agg(F.array(*windows).alias("_w"))
    enough = (F.col("n_rows") >= config.min_rows) & (F.col("n_positives") >= config.min_positives)
    return (
        counted.select(F.inline("_w"))
        .where(F.col("end").isNotNull())
        .withColumn("qualifies", enough)
    )


def select_holdout(
    rows: DataFrame,
    config: HoldoutConfig = HoldoutConfig(),
    *,
    day: str = "published_date",
    label: str = "exploited_30d",
) -> DataFrame:
    """One row: the longest qualifying window, or a reason with the shortest window's counts."""
    tried = holdout_candidates(rows, config, day=day, label=label)
    whole = F.struct("window_days", "start", "end", "n_rows", "n_positives")
    best = tried.agg(
        F.max_by(whole, F.when(F.col("qualifies"), F.col("window_days"))).alias("hit"),
        F.min_by(whole, "window_days").alias("miss"),
    )
    reason = F.format_string(
        SPARSE_REASON,
        F.lit(config.min_rows),
        F.lit(config.min_positives),
        F.col("miss.window_days"),
        F.col("miss.n_rows"),
        F.col("miss.n_positives"),
    )
    shown = F.coalesce("hit", "miss")
    return best.select(
        F.col("hit").isNotNull().alias("selected"),
        F.col("hit.start").alias("start"),
        F.col("hit.end").alias("end"),
        F.col("hit.window_days").alias("window_days"),
        F.coalesce(shown["n_rows"], F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(shown["n_positives"], F.lit(0)).cast("long").alias("n_positives"),
        F.when(F.col("hit").isNull(), F.when(F.col("miss").isNull(), F.lit(EMPTY_REASON)).otherwise(reason)).alias(
            "reason"
        ),
    )


def find_holdout(rows: DataFrame, config: HoldoutConfig = HoldoutConfig(), **names: str) -> Holdout:
    """The selection as a driver value (one row)."""
    row = select_holdout(rows, config, **names).first()
    return Holdout(
        row["start"], row["end"], row["window_days"], row["n_rows"], row["n_positives"], row["reason"]
    )


def holdout_rows(rows: DataFrame, holdout: Holdout, *, day: str = "published_date") -> DataFrame:
    """Rows inside the window; none when no window was found."""
    if not holdout.found:
        return rows.where(F.lit(False))
    return rows.where(F.col(day).between(F.lit(holdout.start), F.lit(holdout.end)))


def content_hash(
    rows: DataFrame,
    *,
    key: str = "cve_id",
    day: str = "published_date",
    label: str = "exploited_30d",
) -> DataFrame:
    """One row: n_rows and SHA-256 over key, date and label, the same at every size.

    Rows are hashed in 16.8 million blocks by key digest, and the block digests
    are combined 4096 at a time, so that no task holds more than a block.
    """
    missing = [c for c in (key, day, label) if c not in rows.columns]
    if missing:
        raise ValueError(f"the holdout hash needs columns {missing}")
    text = F.col(key).cast("string")
    lines = rows.select(
        text.alias("_k"),
        F.concat_ws(
            ",",
            text,
            F.col(day).cast("date").cast("string"),
            F.coalesce(F.col(label).cast("int"), F.lit(0)).cast("string"),
        ).alias("_line"),
    )
    return _block_hash(lines)


def _block_hash(lines: DataFrame) -> DataFrame:
    copies = lines.groupBy("_k", "_line").agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws(",", "_line", F.col("_n").cast("string"))
    level = copies.select(F.sha2("_k", 256).alias("_block"), text.alias("_text"), "_n")
    for digits in BLOCK_DIGITS[:-1]:
        level = (
            level.withColumn("_block", F.substring("_block", 1, digits))
            .groupBy("_block")
            .agg(F.sha2(_joined("_text"), 256).alias("_hash"), F.sum("_n").alias("_n"))
            .select("_block", F.concat_ws(",", "_block", "_hash").alias("_text"), "_n")
        )
    root = level.agg(F.sha2(_joined("_text"), 256).alias("_hash"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"))
    text = F.concat_ws("\n", F.lit(HASH_HEADER), F.concat_ws(",", F.lit(""), "_hash"))
    return root.select("n_rows", F.sha2(text, 256).alias("sha256"))


def _joined(texts: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(texts)), "\n")


@dataclass(frozen=True)
class TrainingRows:
    """Training rows with the facts the guards need."""

    frame: DataFrame
    n_rows: int
    n_positives: int
    first_day: date | None
    last_day: date | None
    holdout_leak: bool


def _facts(frame: DataFrame, day: str, label: str) -> tuple[int, int, date | None, date | None]:
    row = frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("pos"),
        F.min(day).alias("lo"),
        F.max(day).alias("hi"),
    ).first()
    return row["n"], row["pos"], row["lo"], row["hi"]


def training_rows(
    rows: DataFrame,
    holdout: Holdout,
    *,
    day: str = "published_date",
    label: str = "exploited_30d",
    min_rows: int = 100,
    min_positives: int = 5,
    embargo_days: int = 0,
) -> TrainingRows:
    """Rows before the window, or all rows when those are too few.

    The fallback trains on the holdout as well and is flagged as a leak.
    """
    if holdout.found:
        before = rows.where(F.col(day) < F.date_sub(F.lit(holdout.start), embargo_days))
        facts = _facts(before, day, label)
        if facts[0] >= min_rows and facts[1] >= min_positives:
            return TrainingRows(before, *facts, holdout_leak=False)
    return TrainingRows(rows, *_facts(rows, day, label), holdout_leak=holdout.found)


def ordered_split(
    rows: DataFrame,
    *,
    order: tuple[str, ...] = ("published_date", "cve_id"),
    train_share: float = 0.8,
    min_train: int = 10,
    out: str = "is_train",
) -> DataFrame:
    """Flag the first ``max(min_train, share * n)`` rows along a total order.

    The last row to be flagged is found by counting, days first and ids of its day after that; rows are not sorted.
    Rows that are equal in the order are flagged alike.
    """
    n = rows.count()
    cut = max(min_train, int(n * train_share))
    if n <= cut:
        return rows.withColumn(out, F.lit(True))
    bound = order_statistic(rows, cut, order)
    return rows.withColumn(out, at_or_before(bound, order, rows.schema))
