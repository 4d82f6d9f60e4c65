"""Holdouts, folds, splits and metrics."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators.folds import assign_folds, fold_sizing, fold_summary, plan_folds
from riskloom.operators.holdout import (
    HoldoutConfig,
    content_hash,
    find_holdout,
    holdout_candidates,
    holdout_rows,
    ordered_split,
    select_holdout,
    training_rows,
)
from workloads.labels import label_within_30d
from workloads.registry import query, table

NAMES = {"day": "order_date", "label": "within_30d"}
LABELLED = """labelled AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS d,
    coalesce(f.ship <= CAST(o.o_orderdate AS DATE) + 30, FALSE) AS y
  FROM orders o LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem GROUP BY 1) f
    ON f.l_orderkey = o.o_orderkey)"""
_TRIED = (
    LABELLED
    + """,
 tried AS (
  SELECT w.days AS window_days, e.d_max - (w.days - 1) AS start, e.d_max AS "end",
    count(l.d) AS n_rows, coalesce(sum(CAST(l.y AS BIGINT)), 0) AS n_positives
  FROM (VALUES (90), (45), (22), (14)) w(days) CROSS JOIN (SELECT max(d) AS d_max FROM labelled) e
  LEFT JOIN labelled l ON l.d >= e.d_max - (w.days - 1)
  GROUP BY w.days, e.d_max)"""
)


@query(
    f"""WITH {_TRIED} SELECT CAST(window_days AS INTEGER) AS window_days, start, "end", n_rows,
      CAST(n_positives AS BIGINT) AS n_positives, n_rows >= 50 AND n_positives >= 1 AS qualifies FROM tried"""
)
def holdout_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All candidate windows with their counts."""
    return holdout_candidates(label_within_30d(spark, folder), **NAMES)


@query(
    f"""WITH {_TRIED} SELECT TRUE AS selected, start, "end", CAST(window_days AS INTEGER) AS window_days, n_rows,
      CAST(n_positives AS BIGINT) AS n_positives, CAST(NULL AS VARCHAR) AS reason
      FROM tried WHERE n_rows >= 50 AND n_positives >= 1 ORDER BY tried.window_days DESC LIMIT 1"""
)
def holdout_select(spark: SparkSession, folder: str) -> DataFrame:
    """The longest qualifying window."""
    return select_holdout(label_within_30d(spark, folder), **NAMES)


@query(
    f"""WITH {_TRIED} SELECT FALSE AS selected, CAST(NULL AS DATE) AS start, CAST(NULL AS DATE) AS "end",
      CAST(NULL AS INTEGER) AS window_days, n_rows, CAST(n_positives AS BIGINT) AS n_positives,
      'no rolling holdout window met minimums (need >= 2000000000 rows and >= 1 positives; best attempt was last '
        || CAST(window_days AS VARCHAR) || 'd with n=' || CAST(n_rows AS VARCHAR)
        || ', positives=' || CAST(n_positives AS VARCHAR) || ')' AS reason
      FROM tried WHERE window_days = 14"""
)
def holdout_select_none(spark: SparkSession, folder: str) -> DataFrame:
    """No window qualifies: the reason carries the shortest window's counts."""
    config = HoldoutConfig(min_rows=2_000_000_000)
    return select_holdout(label_within_30d(spark, folder), config, **NAMES)


_LINE = "CAST(o_orderkey AS VARCHAR) || ',' || strftime(d, '%Y-%m-%d') || ',' || CAST(CAST(y AS INTEGER) AS VARCHAR)"
_HASH_NAMES = {"key": "o_orderkey", **NAMES}


def _blocks(source: str) -> str:
    """SQL of the digest of ``source`` (o_orderkey, d, y)."""
    return f"""WITH {LABELLED}, hashed AS ({source}),
    b6 AS (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6) AS k,
            sha256(string_agg({_LINE} || ',1', chr(10) ORDER BY {_LINE} || ',1')) AS h FROM hashed GROUP BY 1),
    b3 AS (SELECT substr(k, 1, 3) AS k, sha256(string_agg(k || ',' || h, chr(10) ORDER BY k)) AS h FROM b6 GROUP BY 1),
    r AS (SELECT sha256(string_agg(k || ',' || h, chr(10) ORDER BY k)) AS h FROM b3)
    SELECT (SELECT count(*) FROM hashed) AS n_rows,
      sha256('cve_id,published_date,exploited_30d' || chr(10) || ',' || h) AS sha256 FROM r"""


@query(_blocks("SELECT * FROM labelled WHERE d >= (SELECT max(d) FROM labelled) - 89"))
def holdout_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of the selected window's rows."""
    rows = label_within_30d(spark, folder)
    return content_hash(holdout_rows(rows, find_holdout(rows, **NAMES), day="order_date"), **_HASH_NAMES)


@query(_blocks("SELECT * FROM labelled"))
def content_hash_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of all labelled orders."""
    return content_hash(label_within_30d(spark, folder), **_HASH_NAMES)


@query(
    f"""WITH {LABELLED}, e AS (SELECT max(d) AS last FROM labelled),
    f AS (SELECT i AS fold, last - CAST((3 - i) * 60 - 1 AS INTEGER) AS lo FROM e, range(0, 3) r(i)),
    a AS (SELECT CAST(f.fold AS INTEGER) AS fold, l.d, l.y,
        CASE WHEN l.d <= f.lo - 31 THEN 'train' WHEN l.d BETWEEN f.lo AND f.lo + 59 THEN 'valid' END AS role
      FROM labelled l CROSS JOIN f)
    SELECT fold, role, count(*) AS n_rows, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS n_positives,
      min(d) AS first_day, max(d) AS last_day FROM a WHERE role IS NOT NULL GROUP BY fold, role"""
)
def temporal_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Three embargoed folds of 60 days: size, positives and span of each side."""
    rows = label_within_30d(spark, folder)
    first, last = rows.agg(F.min("order_date"), F.max("order_date")).first()
    folds = plan_folds(first, last, n_splits=3, horizon_days=60, embargo_days=30)
    assigned = assign_folds(rows, folds, day="order_date")
    return fold_summary(assigned, day="order_date", label="within_30d")


@query(
    f"""WITH {LABELLED}, s AS (SELECT max(d) AS last, max(d) - min(d) AS span FROM labelled),
    h AS (SELECT last, span, greatest(30, span // 6) AS h0 FROM s),
    p AS (SELECT last, CAST(h0 AS INTEGER) AS h, CAST(CASE WHEN span < 6 * h0 + 30
        THEN greatest(2, span // (h0 + 30)) ELSE 5 END AS INTEGER) AS n FROM h),
    f AS (SELECT i AS fold, last - CAST((n - i) * h - 1 AS INTEGER) AS lo, h FROM p, range(0, 5) r(i) WHERE i < n)
    SELECT CAST(f.fold AS INTEGER) AS fold, l.o_orderkey,
      CASE WHEN l.d <= f.lo - 31 THEN 'train' ELSE 'valid' END AS role
    FROM labelled l CROSS JOIN f WHERE l.d <= f.lo - 31 OR l.d BETWEEN f.lo AND f.lo + h - 1"""
)
def temporal_fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fold membership of every order with folds sized to the date span."""
    rows = label_within_30d(spark, folder)
    first, last = rows.agg(F.min("order_date"), F.max("order_date")).first()
    n, horizon = fold_sizing((last - first).days, 5, 30)
    folds = plan_folds(first, last, n_splits=n, horizon_days=horizon, embargo_days=30)
    return assign_folds(rows, folds, day="order_date").select("fold", "o_orderkey", "role")


@query(
    f"""WITH {LABELLED} SELECT FALSE AS holdout_leak, count(*) AS n, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS positives,
      min(d) AS first_day, max(d) AS last_day FROM labelled WHERE d < (SELECT max(d) FROM labelled) - 89 - 30"""
)
def train_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left for training before the window, with a 30-day embargo."""
    rows = label_within_30d(spark, folder)
    kept = training_rows(rows, find_holdout(rows, **NAMES), embargo_days=30, **NAMES)
    return kept.frame.agg(
        F.lit(kept.holdout_leak).alias("holdout_leak"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("within_30d").cast("long")).alias("positives"),
        F.min("order_date").alias("first_day"),
        F.max("order_date").alias("last_day"),
    )


@query(
    f"""WITH {LABELLED} SELECT TRUE AS holdout_leak, count(*) AS n, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS positives
      FROM labelled"""
)
def train_partition_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Too few positives before the window: all rows are taken and flagged as a leak."""
    rows = label_within_30d(spark, folder)
    kept = training_rows(rows, find_holdout(rows, **NAMES), min_positives=10**12, **NAMES)
    return kept.frame.agg(
        F.lit(kept.holdout_leak).alias("holdout_leak"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("within_30d").cast("long")).alias("positives"),
    )


@query(
    f"""WITH {LABELLED} SELECT o_orderkey, row_number() OVER (ORDER BY d, o_orderkey)
      <= greatest(10, CAST(floor((SELECT count(*) FROM labelled) * 0.8) AS BIGINT)) AS is_train FROM labelled"""
)
def ordered_train_split(spark: SparkSession, folder: str) -> DataFrame:
    """The first 80 % of orders by date and key."""
    rows = label_within_30d(spark, folder)
    return ordered_split(rows, order=("order_date", "o_orderkey")).select("o_orderkey", "is_train")


# Scores with many ties: discounts in hundredths, some on the edges of the calibration bins.
_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"]
SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus,
    CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS p, l_tax * 10 AS q FROM lineitem)"""
_CURVE = """curve AS (
  SELECT {g}{p} AS p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM scored GROUP BY {g}{p}),
 cum AS (SELECT *, sum(n) OVER ({part}ORDER BY p DESC) AS cn, sum(pos) OVER ({part}ORDER BY p DESC) AS cp FROM curve)"""
_AP = "round(sum(CAST(pos AS DOUBLE) * CAST(cp AS DOUBLE) / CAST(cn AS DOUBLE)) / CAST(sum(pos) AS DOUBLE), 9)"
_AUC = (
    "round(sum(CAST(n - pos AS DOUBLE) * (CAST(cp AS DOUBLE) - pos / 2.0)) "
    "/ (CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE)), 9)"
)

_TWO = "sum(pos) > 0 AND sum(n - pos) > 0"


def _ece_sql(p: str, group: str = "") -> str:
    edges = ", ".join(f"CAST({i} AS DOUBLE) * CAST(0.1 AS DOUBLE)" for i in range(1, 10))
    by = f"{group}, " if group else ""
    having = f"GROUP BY {group}" if group else ""
    return f"""SELECT {by}round(sum(abs(c - h)) / CAST(sum(n) AS DOUBLE), 9) AS ece FROM (
      SELECT {by}b, count(*) AS n, sum(pp) AS c, CAST(sum(y) AS DOUBLE) AS h FROM (
        SELECT *, least(1.0, greatest(0.0, {p})) AS pp,
          len(list_filter([{edges}], lambda e: e <= least(1.0, greatest(0.0, {p})))) AS b FROM scored)
      GROUP BY {by}b) {having}"""


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a label and two scores."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_tax") * 10).alias("q"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query(f"WITH {SCORED}, {_CURVE.format(g='', p='p', part='')} SELECT {_AP} AS auc_pr FROM cum")
def metrics_ap(spark: SparkSession, folder: str) -> DataFrame:
    """Average precision over distinct thresholds."""
    return _rounded(metrics.evaluate(scored_lines(spark, folder), label="y", score="p").select("auc_pr"))


@query(f"WITH {SCORED}, {_CURVE.format(g='', p='p', part='')} SELECT {_AUC} AS auc_roc FROM cum")
def metrics_auc(spark: SparkSession, folder: str) -> DataFrame:
    """ROC AUC with half credit for ties."""
    return _rounded(metrics.evaluate(scored_lines(spark, folder), label="y", score="p").select("auc_roc"))


@query(
    f"""WITH {SCORED} SELECT round(avg(y), 9) AS precision_at_k FROM (
      SELECT y FROM scored ORDER BY p DESC, {", ".join(_TIE)} LIMIT 500)"""
)
def metrics_p_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Precision among the 500 best rows."""
    rows = scored_lines(spark, folder)
    return _rounded(metrics.precision_at_k(rows, label="y", score="p", k=500, tie_break=_TIE))


@query(
    f"""WITH {SCORED} SELECT l_linestatus, round(avg(y), 9) AS precision_at_k FROM (
      SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY p DESC, {", ".join(_TIE)}) AS r FROM scored)
      WHERE r <= 2500 GROUP BY l_linestatus"""
)
def metrics_p_at_large_k(spark: SparkSession, folder: str) -> DataFrame:
    """Precision among each status's 2500 best rows, beyond Spark's own group limit."""
    rows = scored_lines(spark, folder)
    top = metrics.precision_at_k(
        rows, label="y", score="p", k=2500, tie_break=_TIE, groups=["l_linestatus"]
    )
    return _rounded(top)


@query(
    f"""WITH {SCORED} SELECT l_linestatus, round(avg((least(1.0, greatest(0.0, p)) - y) ** 2), 9) AS brier
      FROM scored GROUP BY l_linestatus"""
)
def metrics_brier(spark: SparkSession, folder: str) -> DataFrame:
    """Brier score per line status."""
    rows = scored_lines(spark, folder)
    return _rounded(metrics.brier(rows, label="y", score="p", groups=["l_linestatus"]))


@query(f"WITH {SCORED} {_ece_sql('p')}")
def metrics_ece(spark: SparkSession, folder: str) -> DataFrame:
    """Expected calibration error with scores on bin edges."""
    return _rounded(metrics.calibration_error(scored_lines(spark, folder), label="y", score="p"))


_BUNDLE = f"""
 base AS (SELECT l_linestatus, sum(n) AS n, sum(pos) AS positives, {_AP} AS auc_pr, {_AUC} AS auc_roc
   FROM cum GROUP BY l_linestatus),
 br AS (SELECT l_linestatus, round(avg((least(1.0, greatest(0.0, p)) - y) ** 2), 9) AS brier
   FROM scored GROUP BY l_linestatus),
 ec AS ({_ece_sql("p", "l_linestatus")}),
 top AS (SELECT l_linestatus, round(avg(y), 9) AS precision_at_k FROM (SELECT *, row_number() OVER (
   PARTITION BY l_linestatus ORDER BY p DESC, {", ".join(_TIE)}) AS r FROM scored) WHERE r <= 100
   GROUP BY l_linestatus)"""


@query(
    f"""WITH {SCORED}, {_CURVE.format(g="l_linestatus, ", p="p", part="PARTITION BY l_linestatus ")}, {_BUNDLE}
    SELECT base.l_linestatus, CAST(base.n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives,
      auc_pr, auc_roc, brier, ece, precision_at_k
    FROM base JOIN br USING (l_linestatus) JOIN ec USING (l_linestatus) JOIN top USING (l_linestatus)"""
)
def metrics_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """All five metrics per line status in one job."""
    rows = scored_lines(spark, folder)
    return _rounded(
        metrics.metric_bundle(rows, label="y", score="p", k=100, tie_break=_TIE, groups=["l_linestatus"])
    )


@query(
    f"""WITH {LABELLED}, e AS (SELECT max(d) AS last FROM labelled),
    f AS (SELECT i AS fold, last - CAST((3 - i) * 60 - 1 AS INTEGER) AS lo FROM e, range(0, 3) r(i)),
    scored AS (SELECT f.fold, CAST(l.y AS INTEGER) AS y, o.o_totalprice / 600000 AS p
      FROM labelled l JOIN orders o ON o.o_orderkey = l.o_orderkey
      JOIN f ON l.d BETWEEN f.lo AND f.lo + 59),
    {_CURVE.format(g="fold, ", p="p", part="PARTITION BY fold ")},
    m AS (SELECT fold, CASE WHEN {_TWO} THEN {_AP} ELSE CAST('NaN' AS DOUBLE) END AS ap,
      CASE WHEN {_TWO} THEN {_AUC} ELSE CAST('NaN' AS DOUBLE) END AS auc FROM cum GROUP BY fold),
    b AS (SELECT fold, avg((least(1.0, greatest(0.0, p)) - y) ** 2) AS br FROM scored GROUP BY fold)
    SELECT round(avg(ap), 6) AS auc_pr, round(avg(auc), 6) AS auc_roc, round(avg(br), 6) AS brier
    FROM m JOIN b USING (fold)"""
)
def fold_metrics_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every validation fold in one job, averaged over the folds."""
    rows = label_within_30d(spark, folder)
    first, last = rows.agg(F.min("order_date"), F.max("order_date")).first()
    folds = plan_folds(first, last, n_splits=3, horizon_days=60, embargo_days=30)
    valid = assign_folds(rows, folds, day="order_date").where("role = 'valid'")
    prices = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 600000).alias("p"))
    scored = valid.join(prices, "o_orderkey")
    per_fold = metrics.evaluate(scored, label="within_30d", score="p", groups=["fold"])
    return per_fold.agg(*[F.round(F.avg(m), 6).alias(m) for m in ("auc_pr", "auc_roc", "brier")])


# Scores with as many distinct values as rows, so that the slices carry totals.
@query(
    f"""WITH scored AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y,
        o_totalprice / 600000 + CAST(o_orderkey AS DOUBLE) / 1e12 AS p FROM orders),
      {_CURVE.format(g="", p="p", part="")} SELECT {_AP} AS auc_pr, {_AUC} AS auc_roc FROM cum"""
)
def metrics_distinct_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AUCs of nearly continuous scores."""
    rows = table(spark, folder, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / 600000 + F.col("o_orderkey").cast("double") / 1e12).alias("p"),
    )
    return _rounded(metrics.evaluate(rows, label="y", score="p", slices=50).select("auc_pr", "auc_roc"))


_COMPARE = f"""
 cp AS (SELECT 'model' AS model, * FROM ({{p}}) UNION ALL SELECT 'baseline' AS model, * FROM ({{q}}))"""


def _side(p: str) -> str:
    curve = _CURVE.format(g="", p=p, part="")
    return f"""WITH {curve}
      SELECT {_AP} AS auc_pr, {_AUC} AS auc_roc,
        (SELECT round(avg((least(1.0, greatest(0.0, {p})) - y) ** 2), 9) FROM scored) AS brier,
        (SELECT ece FROM ({_ece_sql(p)})) AS ece,
        (SELECT round(avg(y), 9) FROM (SELECT y FROM scored ORDER BY {p} DESC, {", ".join(_TIE)} LIMIT 100))
          AS precision_at_k FROM cum"""


_BOTH = f"WITH {SCORED}, {_COMPARE.format(p=_side('p'), q=_side('q'))}"


@query(
    f"""{_BOTH} SELECT model, auc_pr, auc_roc, brier, ece, precision_at_k,
      round(auc_pr - (SELECT auc_pr FROM cp WHERE model = 'baseline'), 6) AS lift_auc_pr FROM cp"""
)
def model_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores on the same rows with the lift of one over the other."""
    made = _compared(spark, folder, 1.0).drop("n", "positives", "gate_passed")
    return made.withColumn("lift_auc_pr", F.round("lift_auc_pr", 6))


def _compared(spark: SparkSession, folder: str, margin: float) -> DataFrame:
    return _rounded(
        metrics.compare_models(
            scored_lines(spark, folder),
            {"model": "p", "baseline": "q"},
            label="y",
            baseline="baseline",
            k=100,
            tie_break=_TIE,
            margin=margin,
        )
    )


@query(
    f"""{_BOTH} SELECT model, (SELECT auc_pr FROM cp WHERE model = 'baseline') - auc_pr <= -0.0001 AS gate_passed
      FROM cp"""
)
def metric_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate with a margin that asks for a small lead over the baseline."""
    return _compared(spark, folder, -0.0001).select("model", "gate_passed")


