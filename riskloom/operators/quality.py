"""Data-quality checks: a schema contract, then every value rule in one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.identifiers import CVE_EXACT, CWE_EXACT

# The severities a master row may carry.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


# An aggregate over the table, or a function of the table that gives a scalar subquery.
Measure = Column | Callable[[DataFrame], Column]
# Fixed value: elements shown as examples of a failed check.
EXAMPLES = 5


@dataclass(frozen=True)
class Rule:
    """``bad`` is the number of violations; ``detail`` a text shown with them."""

    name: str
    bad: Measure
    detail: Measure | None = None


def violations(condition: Column) -> Column:
    """Number of rows for which ``condition`` is true."""
    return F.count_if(condition)


def not_null(*columns: str) -> Column:
    """Rows with a null in any of the columns."""
    bad = F.lit(False)
    for name in columns:
        bad = bad | F.col(name).isNull()
    return violations(bad)


def matches(column: str, pattern: str) -> Column:
    """Rows whose value is null or does not match."""
    return violations(F.col(column).isNull() | ~F.col(column).rlike(pattern))


def unique(column: str) -> Measure:
    """Rows beyond the first of each value; null counts as a value.

    Counted by itself over that one column, so that the other checks need not be grouped by it.
    """

    def extra(df: DataFrame) -> Column:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()

    return extra


def within(column: str, low: float, high: float) -> Column:
    """Non-null values outside [low, high]; NaN is outside."""
    value = F.col(column).cast("double")
    return violations(value.isNotNull() & (F.isnan(value) | (value < low) | (value > high)))


def one_of(column: str, allowed: Sequence[str]) -> Column:
    """Non-null values outside the domain."""
    return violations(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def never_negative(column: str) -> Column:
    """Null or negative values."""
    return violations(F.col(column).isNull() | (F.col(column) < 0))


def in_order(first: str, second: str) -> Column:
    """Rows whose second value precedes the first."""
    return violations(F.col(second) < F.col(first))


def flag_iff_present(flag: str, value: str) -> Column:
    """Rows where the flag and the presence of the value disagree."""
    return violations(~F.col(flag).eqNullSafe(F.col(value).isNotNull()))


def elements_match(column: str, pattern: str) -> Column:
    """Rows with a non-null array element that does not match."""
    return violations(F.coalesce(F.exists(column, lambda x: ~x.rlike(pattern)), F.lit(False)))


def bad_elements(column: str, pattern: str) -> Measure:
    """The first offending elements in text order, as examples."""

    def examples(df: DataFrame) -> Column:
        wrong = df.select(F.explode(F.filter(column, lambda x: ~x.rlike(pattern))).alias("_e")).distinct()
        first = wrong.orderBy("_e").limit(EXAMPLES)
        return first.agg(F.array_join(F.array_sort(F.collect_list("_e")), ", ")).scalar()

    return examples


def schema_errors(df: DataFrame, contract: StructType) -> list[str]:
    """Differences in order, presence and type."""
    errors = []
    if df.columns != contract.names:
        errors.append(f"columns are {', '.join(df.columns)}; expected are {', '.join(contract.names)}")
    for field in contract:
        if field.name not in df.columns:
            errors.append(f"no column {field.name}")
        elif df.schema[field.name].dataType != field.dataType:
            got = df.schema[field.name].dataType.simpleString()
            errors.append(f"{field.name} is {got}; expected is {field.dataType.simpleString()}")
    return errors


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: check, n_rows, n_bad, passed, detail.

    One pass over ``df`` for all rules but those on duplicates and examples, which read a single column each.
    """
    measures = {f"_b{i}": (r.bad, "long") for i, r in enumerate(rules)}
    measures |= {f"_d{i}": (r.detail, "string") for i, r in enumerate(rules) if r.detail is not None}
    plain = {name: m.cast(kind) for name, (m, kind) in measures.items() if isinstance(m, Column)}
    apart = {name: m(df).cast(kind) for name, (m, kind) in measures.items() if not isinstance(m, Column)}
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[m.alias(name) for name, m in plain.items()]).withColumns(apart)
    lines = [
        F.struct(
            F.lit(r.name).alias("check"),
            F.col("_n").alias("n_rows"),
            F.col(f"_b{i}").alias("n_bad"),
            (F.col(f"_b{i}") == 0).alias("passed"),
            (F.when(F.col(f"_b{i}") > 0, F.col(f"_d{i}")) if r.detail is not None else F.lit(None).cast("string")).alias(
                "detail"
            ),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*lines)))


def master_rules() -> list[Rule]:
    """The rules of the master table."""
    extremes = {
        c: F.concat(F.lit("min="), F.min(c).cast("string"), F.lit(" max="), F.max(c).cast("string"))
        for c in ("cvss_v3_base_score", "epss_score", "epss_percentile")
    }
    flags = F.concat(
        F.lit("in_kev="),
        F.count_if(F.col("in_kev")).cast("string"),
        F.lit(" dates="),
        F.count("kev_date_added").cast("string"),
    )
    severity = F.col("cvss_v3_severity")
    return [
        Rule("cve_id_format", matches("cve_id", CVE_EXACT)),
        Rule("cve_id_unique", unique("cve_id")),
        Rule("dates_present", not_null("published_date", "last_modified_date")),
        Rule("modified_not_before_published", in_order("published_date", "last_modified_date")),
        Rule("cvss_v3_base_score_range", within("cvss_v3_base_score", 0, 10), extremes["cvss_v3_base_score"]),
        Rule(
            "cvss_v3_severity_domain",
            one_of("cvss_v3_severity", SEVERITIES),
            F.min(F.when(~severity.isin(*SEVERITIES), severity)),
        ),
        *[Rule(f"{c}_non_negative", never_negative(c)) for c in ("vendor_count", "product_count", "description_len")],
        *[Rule(f"{c}_present", not_null(c)) for c in ("ref_has_exploit", "ref_has_patch", "in_kev", "exploited_30d")],
        *[Rule(f"{c}_range", within(c, 0, 1), extremes[c]) for c in ("epss_score", "epss_percentile")],
        Rule("kev_date_iff_in_kev", flag_iff_present("in_kev", "kev_date_added"), flags),
        Rule("cwe_id_format", elements_match("cwe_ids", CWE_EXACT), bad_elements("cwe_ids", CWE_EXACT)),
    ]


def validate(df: DataFrame, contract: StructType, rules: Sequence[Rule]) -> DataFrame:
    """Rule results, or one failed row per schema error when the contract is not met.

    A schema error counts against every row of the table.
    """
    errors = schema_errors(df, contract)
    if not errors:
        return check(df, rules)
    every = F.col("n_rows")
    failures = [
        F.struct(F.lit("schema").alias("check"), every, every.alias("n_bad"), F.lit(False).alias("passed"), F.lit(text).alias("detail"))
        for text in errors
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*failures)))


def roll_up(results: DataFrame, table: str) -> DataFrame:
    """One summary row: table, n_rows, n_errors, errors, validated_at, passed."""
    failed = ~F.col("passed")
    text = F.concat_ws(": ", F.col("check"), F.concat(F.col("n_bad").cast("string"), F.lit(" rows")), F.col("detail"))
    return results.agg(
        F.lit(table).alias("table"),
        F.max("n_rows").alias("n_rows"),
        F.count_if(failed).alias("n_errors"),
        # One entry per failed check, so the list is as short as the rule set.
        F.array_sort(F.collect_list(F.when(failed, text))).alias("errors"),
        F.current_timestamp().alias("validated_at"),
        (F.count_if(failed) == 0).alias("passed"),
    )
