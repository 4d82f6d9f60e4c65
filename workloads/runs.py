"""Whole runs: daily ingest, training facts, holdout reports, and what of them SQL can state."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, timedelta

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.assemble import epss_as_of, feature_frame, feature_names
from riskloom.operators.quality import roll_up
from riskloom.plans.evaluation import ablations, evaluate_model
from riskloom.plans.incremental import read_master
from riskloom.plans.ingest import daily_ingest
from riskloom.plans.leafwise import UNITS, best_splits, histograms, with_bins
from riskloom.plans.silver import validate_rows
from riskloom.plans.training import score_frame, train, with_residual
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources.registry import load_latest, runs, save_run
from riskloom.sources.versioned import latest_version
from workloads import derived, flattening
from workloads.evaluation import _AP, _AUC, _CURVE
from workloads.features import _TABULAR
from workloads.flattening import nvd_records
from workloads.joins import _AS_OF, _KNOWN
from workloads.models import _EVAL, _TRAIN, TODAY, _frame, _trained
from workloads.registry import query, table
from workloads.storage import land_pages

# -- features and targets


@query(
    derived.WITH_MASTER
    + f""" SELECT cve_id, CAST(CAST(CAST(CAST(exploited_30d AS INTEGER) AS DOUBLE)
      - CAST({_KNOWN.format(c="epss_score")} AS DOUBLE) AS FLOAT) AS DOUBLE) AS target FROM master"""
)
def residual_target(spark: SparkSession, folder: str) -> DataFrame:
    """What the model is trained on: label minus the score known at publication."""
    made = with_residual(epss_as_of(derived.master(spark, folder), None), out="target")
    return made.select("cve_id", "target")


_NAMES = sorted([*re.findall(r"AS (f_\w+)", _TABULAR), "f_epss_score", "f_epss_percentile"])
_TOTALS = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {i} AS place, {'NULL' if n.startswith('f_epss') else i - sum(m.startswith('f_epss') for m in _NAMES[:i])}"
    f" AS place_without_scores, count(*) AS n, round(sum(CAST({n} AS DOUBLE)), 2) AS total FROM frame"
    for i, n in enumerate(_NAMES)
)


@query(
    f"""{derived.WITH_MASTER}, frame AS (SELECT {_TABULAR}, CAST(coalesce(epss_score, 0) AS DOUBLE) AS f_epss_score,
      CAST(coalesce(epss_percentile, 0) AS DOUBLE) AS f_epss_percentile FROM master) {_TOTALS}"""
)
def model_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The model's inputs in order, with and without the baseline's own columns, and their totals."""
    frame = feature_frame(derived.master(spark, folder), point_in_time=False, include_temporal=False)
    names, without = feature_names(frame), feature_names(frame, without_epss=True)
    rows = [
        F.struct(
            F.lit(n).alias("feature"),
            F.lit(i).alias("place"),
            F.lit(without.index(n) if n in without else None).cast("int").alias("place_without_scores"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(F.col(n).cast("double")), 2).alias("total"),
        )
        for i, n in enumerate(names)
    ]
    return frame.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


# -- ingest

_SINCE, _TARGET = date(2000, 1, 1), date(2024, 3, 2)
_PART_ID = derived.cve_sql("CVE-2023-", "p_partkey")


def _land_feeds(spark: SparkSession, folder: str) -> str:
    """Parts as record pages, returned lines as catalog entries, part sizes as one day's scores."""
    landing = scratch_path(spark, "feeds")
    land_pages(nvd_records(spark, folder), f"{landing}/nvd/records-{_SINCE}.json", 2)
    marked = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    entry = F.struct(derived.cve("CVE-2023-", "l_partkey").alias("cveID"), F.to_date("l_shipdate").cast("string").alias("dateAdded"))
    # The catalog names an id once.
    first = marked.groupBy("l_partkey").agg(F.min("l_shipdate").alias("l_shipdate"))
    land_pages(first.select(F.col("l_partkey").alias("_pos"), F.to_json(entry).alias("_json")), f"{landing}/kev", 1)
    scores = table(spark, folder, "part").where("p_partkey % 3 <> 0").select(
        derived.cve("CVE-2023-", "p_partkey").alias("cve"), (F.col("p_size") / 64).alias("epss"), (F.col("p_size") / 128).alias("percentile"), F.lit("x").alias("more")
    )
    day = _TARGET - timedelta(days=2)
    scores.write.option("header", True).csv(f"{landing}/epss/scores-{day}.csv")
    return landing


@query(
    f"""WITH flat AS ({flattening.NVD_FLAT}), marks AS (
      SELECT {derived.cve_sql("CVE-2023-", "l_partkey")} AS cve_id, min(CAST(l_shipdate AS DATE)) AS d
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    scores AS (SELECT {_PART_ID} AS cve_id, CAST(CAST(p_size / 64.0 AS FLOAT) AS DOUBLE) AS s FROM part WHERE p_partkey % 3 <> 0)
    SELECT flat.cve_id, flat.published_date, flat.description_len, flat.cwe_ids, s AS epss_score,
      CASE WHEN s IS NOT NULL THEN DATE '{_TARGET - timedelta(days=2)}' END AS epss_snapshot_date, d IS NOT NULL AS in_kev,
      d AS kev_date_added, coalesce(d <= flat.published_date + 30, FALSE) AS exploited_30d, TRUE AS same_in_place, 1 AS version
    FROM flat LEFT JOIN marks USING (cve_id) LEFT JOIN scores USING (cve_id)"""
)
def daily_ingest_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Landed feeds to the master table: once in place, and twice incrementally, the second time without a change."""
    landing, data = _land_feeds(spark, folder), scratch_path(spark, "ingested")
    daily_ingest(spark, landing, data, _TARGET, nvd_since=_SINCE)
    for _ in range(2):
        daily_ingest(spark, landing, data, _TARGET, nvd_since=_SINCE, incremental=True)
    root = f"{data}/silver/cve_master_versions"
    master = read_master(spark, root)
    plain = spark.read.parquet(f"{data}/silver/cve_master")
    same = plain.select(F.col("cve_id").alias("_id"), F.xxhash64(*master.columns).alias("_h"))
    joined = master.withColumn("_own", F.xxhash64(*master.columns)).join(same, F.col("cve_id") == F.col("_id"), "left")
    return joined.select(
        "cve_id", "published_date", "description_len", F.array_join("cwe_ids", "|").alias("cwe_ids"), F.col("epss_score").cast("double").alias("epss_score"),
        "epss_snapshot_date", "in_kev", "kev_date_added", "exploited_30d", (F.col("_own") == F.col("_h")).alias("same_in_place"),
        F.lit(latest_version(spark, root)).alias("version"),
    )


@query(derived.WITH_MASTER + " SELECT 'master' AS \"table\", count(*) AS n_rows, 0 AS n_errors, 0 AS listed, TRUE AS passed FROM master")
def validation_written(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of all checks on the master table, written as JSON and read back."""
    path = scratch_path(spark, "validation")
    validate_rows(spark, derived.master(spark, folder), "master", path)
    shape = roll_up(spark.createDataFrame([], "check string, n_rows bigint, n_bad bigint, passed boolean, detail string"), "").schema
    found = spark.read.schema(shape).json(path)
    return found.select("table", "n_rows", F.col("n_errors").cast("int").alias("n_errors"), F.size("errors").alias("listed"), "passed")


# -- training and reports

_WINDOW = """
 ends AS (SELECT max(published_date) AS last FROM master),
 tried AS (SELECT w.days, ends.last - (w.days - 1) AS start, ends.last AS stop, count(m.cve_id) AS n,
     coalesce(sum(CAST(m.exploited_30d AS BIGINT)), 0) AS pos
   FROM (VALUES (90), (45), (22), (14)) w(days) CROSS JOIN ends
   LEFT JOIN master m ON m.published_date >= ends.last - (w.days - 1) GROUP BY w.days, ends.last),
 win AS (SELECT * FROM tried WHERE n >= 50 AND pos >= 1 ORDER BY days DESC LIMIT 1),
 held AS (SELECT m.* FROM master m, win WHERE m.published_date BETWEEN win.start AND win.stop),
 before AS (SELECT m.* FROM master m, win WHERE m.published_date < win.start)"""


@query(
    f"""{derived.WITH_MASTER}, {_WINDOW}
    SELECT (SELECT count(*) FROM master) AS n_scored, 0 AS n_differ, 2 AS n_runs, TRUE AS is_latest, 2 AS n_folds, 18 AS n_features,
      (SELECT count(*) FROM master) AS n_rows_closed, (SELECT count(*) FROM before) AS n_rows,
      (SELECT CAST(sum(CAST(exploited_30d AS BIGINT)) AS BIGINT) FROM before) AS n_positives, FALSE AS holdout_leak,
      n AS heldout_n_rows, CAST(pos AS BIGINT) AS heldout_n_positives, start AS heldout_window_start, stop AS heldout_window_end,
      CAST(days AS INTEGER) AS heldout_window_days FROM win"""
)
def training_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A run saved, a later one of the same rows saved over it, the latest loaded: its facts, and that it scores as it did."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    root = scratch_path(spark, "registry")
    save_run(spark, root, run.model, {**run.metadata, "run_id": "earlier", "trained_at": "2000-01-01T00:00:00+00:00"})
    save_run(spark, root, run.model, run.metadata)
    model, facts = load_latest(spark, root)
    own = score_frame(frame, run.model).withColumnRenamed("predicted", "own")
    scored = score_frame(frame, model).join(own, "cve_id")
    numbers = ("n_features", "n_rows_closed", "n_rows", "n_positives", "holdout_leak", "heldout_n_rows", "heldout_n_positives", "heldout_window_days")
    days = ("heldout_window_start", "heldout_window_end")
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("predicted") != F.col("own")).alias("n_differ")).select(
        "*",
        F.lit(runs(spark, root).count()).alias("n_runs"),
        F.lit(facts["run_id"] == run.metadata["run_id"]).alias("is_latest"),
        F.lit(len(facts["fold_metrics"])).alias("n_folds"),
        *[F.lit(facts[n]).alias(n) for n in numbers],
        *[F.lit(facts[n]).cast("date").alias(n) for n in days],
    )


@query()
def residual_search(spark: SparkSession, folder: str) -> DataFrame:
    """Depth, leaves and smallest leaf searched per fold, side by side; one row for each fold with what it settled on."""
    config = replace(
        _TRAIN, booster=replace(_TRAIN.booster, max_iter=2), depth_grid=(2, 3, 4), leaves_grid=(3, 5, 9), min_instances_grid=(10, 20, 40)
    )
    facts = train(_frame(spark, folder), config, today=TODAY).metadata
    rows = [
        (int(fold), p["max_depth"], p["num_leaves"], p["min_instances"], next(m["auc_pr"] for m in facts["fold_metrics"] if m["fold"] == int(fold)))
        for fold, p in facts["fold_params"].items()
    ]
    found = spark.createDataFrame(rows, "fold int, max_depth int, num_leaves int, min_instances int, auc_pr double")
    return found.withColumn("n_rows", F.lit(facts["n_rows"]))


_BASELINE = f"""{_AS_OF}, {_WINDOW},
 scored AS (SELECT h.cve_id, CAST(h.exploited_30d AS INTEGER) AS y, coalesce(CAST(a.epss_score AS DOUBLE), 0) AS p
   FROM held h JOIN as_of a ON a.cve_id = h.cve_id),
 {_CURVE.format(g="", p="p", part="")},
 m AS (SELECT CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN {_AP} END AS auc_pr,
   CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN {_AUC} END AS auc_roc FROM cum),
 rest AS (SELECT round(avg((least(1.0, greatest(0.0, p)) - y) ** 2), 9) AS brier, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS coverage,
   count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM scored),
 top AS (SELECT round(avg(y), 9) AS precision_at_k FROM (SELECT y FROM scored ORDER BY p DESC, cve_id LIMIT 100))"""
_VALUES = ("auc_pr", "auc_roc", "precision_at_k", "brier")


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.round(c, 9)) for c in _VALUES})


@query(
    f"""{derived.WITH_MASTER}, {_BASELINE}
    SELECT 'ok' AS status, win.start AS window_start, win.stop AS window_end, CAST(win.days AS INTEGER) AS window_days,
      (SELECT count(*) FROM master) AS closed_rows, (SELECT min(published_date) FROM master) AS closed_first,
      (SELECT max(published_date) FROM master) AS closed_last, (SELECT min(published_date) FROM before) AS train_first,
      (SELECT max(published_date) FROM before) AS train_last, round(coverage, 9) AS baseline_coverage, rest.n, positives,
      auc_pr, auc_roc, precision_at_k, brier, CAST(0 AS DOUBLE) AS lift_auc_pr FROM win, m, rest, top"""
)
def holdout_report_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline's row of the holdout report, with the window and what is known of it."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    report = evaluate_model(frame, run.model, run.metadata, today=TODAY, config=_EVAL).where("model = 'baseline'")
    facts = ("status", "window_start", "window_end", "window_days", "closed_rows", "closed_first", "closed_last", "train_first", "train_last")
    return _rounded_metrics(report).select(
        *facts, F.round("baseline_coverage", 9).alias("baseline_coverage"), "n", "positives", *_VALUES, F.coalesce(F.nanvl("lift_auc_pr", F.lit(0.0)), F.lit(0.0)).alias("lift_auc_pr")
    )


@query(
    f"""{derived.WITH_MASTER}, {_BASELINE}
    SELECT 'baseline_only' AS variant, auc_pr, auc_roc, precision_at_k, brier, 4 AS n_variants FROM m, rest, top"""
)
def ablation_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline's row of the ablation table, and how many variants there are."""
    frame = _frame(spark, folder)
    run = _trained(frame)
    made = cut_lineage(ablations(frame, run.model, run.metadata, today=TODAY, config=_EVAL))
    n = made.count()
    return _rounded_metrics(made.where("variant = 'baseline_only'")).select("variant", *_VALUES, F.lit(n).alias("n_variants"))


_EDGES = [[float(i) for i in range(1, 50)], [i / 100 for i in range(10)], [i / 100 for i in range(8)], [float(i) for i in range(1, 7)]]
_SPLIT_ON = ("l_quantity", "l_discount", "l_tax", "CAST(l_linenumber AS DOUBLE)")
_TRIES = " UNION ALL ".join(
    f"SELECT l_linestatus AS leaf, {f} AS feature, i AS cut, v, {c} AS x, y FROM lines, (SELECT unnest({own}) AS v, unnest(range({len(own)})) AS i)"
    for f, (c, own) in enumerate(zip(_SPLIT_ON, _EDGES))
)


@query(
    f"""WITH lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
    tries AS (SELECT leaf, feature, cut, count(*) AS n, sum(y) AS g, count(*) FILTER (WHERE x <= v) AS nl, coalesce(sum(y) FILTER (WHERE x <= v), 0) AS gl
      FROM ({_TRIES}) GROUP BY leaf, feature, cut),
    gains AS (SELECT *, CAST(gl AS DOUBLE) * gl / nl + CAST(g - gl AS DOUBLE) * (g - gl) / (n - nl) - CAST(g AS DOUBLE) * g / n AS gain
      FROM tries WHERE nl >= 20 AND n - nl >= 20)
    SELECT leaf, CAST(feature AS INTEGER) AS feature, CAST(cut AS INTEGER) AS cut, n, nl AS n_left, round(gain, 6) AS gain FROM (
      SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY round(gain, 9) DESC, feature, cut) AS r FROM gains) WHERE r = 1 AND gain > 0"""
)
def leafwise_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The best split of two leaves from one table of histograms: returned lines by quantity, discount, tax and number."""
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    lines = VectorAssembler(inputCols=names, outputCol="v").transform(table(spark, folder, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")))
    rows = with_bins(lines, "v", _EDGES).select(
        "l_linestatus", "_bins", ((F.col("l_returnflag") == "R").cast("long") * UNITS).alias("_g"), F.lit(UNITS).cast("long").alias("_h")
    )
    found = best_splits(histograms(rows, F.col("l_linestatus"), range(4)), 20).where("best.gain is not null")
    return found.select(
        "leaf", F.col("best.feature").alias("feature"), F.col("best.bin").cast("int").alias("cut"), F.col("total.n_all").alias("n"),
        F.col("best.left.n_left").alias("n_left"), F.round(F.col("best.gain") / UNITS, 6).alias("gain"),
    )
