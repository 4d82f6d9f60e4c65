"""Landed feeds to ranked inventories on a small synthetic history."""

from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators.assemble import feature_frame
from riskloom.operators.holdout import HoldoutConfig
from riskloom.plans.boosting import BoosterParams, Calibrator, DegenerateTarget, assembler, fit_booster, fit_calibrator
from riskloom.plans.evaluation import EvalConfig, ablations, evaluate_model, gate
from riskloom.plans.ingest import daily_ingest
from riskloom.plans.ranking import load_product_index, rank_documents
from riskloom.plans.training import NotEnoughData, TrainConfig, greedy_search, score_frame, train
from riskloom.sources import bronze
from riskloom.sources.registry import latest_run, load_latest, save_run

START, DAYS, EVERY = date(2021, 2, 3), 260, 15
TARGET = START + timedelta(days=DAYS + 60)
SINCE = date(2021, 1, 20)
BOOSTER = BoosterParams(max_iter=3, max_depth=2, min_instances=5, step_size=0.3)
TRAIN = TrainConfig(
    n_splits=2,
    top_k=10,
    booster=BOOSTER,
    depth_grid=(2,),
    leaves_grid=(4,),
    min_instances_grid=(5,),
    holdout=HoldoutConfig(holdout_days=60, min_rows=40),
)
EVAL = EvalConfig(top_k=10, booster=BOOSTER, holdout=TRAIN.holdout)


def cve(i):
    return f"CVE-2021-{7000 + 3 * i}"


def land(folder):
    """One vulnerability a day; one in every so many is listed as exploited nine days later."""
    records, marks = [], []
    for name in ("nvd", "kev", "epss"):
        (folder / name).mkdir(parents=True)
    for i in range(DAYS):
        day, hit = START + timedelta(days=i), i % EVERY == 0
        product = ("harbor", "7.4.1") if i % 4 == 0 else ("lantern", "0.9.3")
        data = {
            "baseScore": 8.8 if hit else 4.0 + i % 4,
            "baseSeverity": "HIGH" if hit or i % 4 == 3 else "MEDIUM",
            "vectorString": "CVSS:3.1/AV:L/AC:H/PR:L/UI:R/S:C/C:L/I:L/A:N",
        }
        records.append(
            {
                "cve": {
                    "id": cve(i),
                    "published": f"{day}T00:00:00.000",
                    "lastModified": f"{day + timedelta(days=6)}T08:30:00.000",
                    "descriptions": [{"lang": "en", "value": "a fault in " + product[0] * (1 + i % 5)}],
                    "metrics": {"cvssMetricV31": [{"type": "Primary", "cvssData": data}]},
                    "weaknesses": [{"description": [{"value": ("CWE-416", "CWE-190", "CWE-862")[i % 3]}]}],
                    "configurations": [
                        {"nodes": [{"cpeMatch": [{"criteria": f"cpe:2.3:a:v:{product[0]}:{product[1]}:*"}]}]}
                    ],
                    "references": [{"tags": ["Patch", "Exploit"] if hit else ["Patch"]}],
                }
            }
        )
        if hit:
            marks.append({"cveID": cve(i), "dateAdded": str(day + timedelta(days=9))})
    (folder / "nvd" / f"nvd_{SINCE}.json").write_text(json.dumps({"vulnerabilities": records}))
    (folder / "kev" / "kev.json").write_text(json.dumps({"vulnerabilities": marks}))


def score_of(i):
    return (0.62, 0.9) if i % EVERY == 0 else (0.02 * (1 + i % 7), 0.1 + 0.05 * (i % 7))


def land_scores(folder, day):
    lines = [f"{cve(i)},{score_of(i)[0]:.4f},{score_of(i)[1]:.4f}" for i in range(DAYS) if START + timedelta(days=i) <= day]
    (folder / "epss" / f"epss_scores-{day}.csv").write_text("#v1\ncve,epss,percentile\n" + "\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("flow")
    land(base / "landing")
    # The day before the target has not landed, so the one before it is taken.
    land_scores(base / "landing", TARGET - timedelta(days=2))
    result = daily_ingest(spark, str(base / "landing"), str(base / "data"), TARGET, nvd_since=SINCE)
    return base, result


@pytest.fixture(scope="module")
def frame(spark, stored):
    master = spark.read.parquet(f"{stored[0]}/data/silver/cve_master")
    rows = [(cve(i), *map(float, score_of(i)), START + timedelta(days=i)) for i in range(DAYS)]
    history = spark.createDataFrame(rows, "cve_id string, epss_score float, epss_percentile float, snapshot_date date")
    return feature_frame(master, history=history).persist()


@pytest.fixture(scope="module")
def run(frame):
    return train(frame, TRAIN, today=TARGET)


def test_ingest(spark, stored):
    base, result = stored
    assert result.silver and result.passed and result.epss_day == TARGET - timedelta(days=2)
    master = spark.read.parquet(f"{base}/data/silver/cve_master")
    assert master.count() == DAYS
    assert master.where("exploited_30d and in_kev").count() == -(-DAYS // EVERY)
    assert master.where("epss_score is null").count() == 0
    again = daily_ingest(spark, f"{base}/landing", f"{base}/data", TARGET, nvd_since=SINCE)
    assert again == result and spark.read.parquet(f"{base}/data/silver/cve_master").count() == DAYS
    assert bronze.read_epss_history(spark, f"{base}/data/bronze/epss").count() == DAYS


def test_partial_ingest(spark, stored, tmp_path):
    base, _ = stored
    only = daily_ingest(spark, f"{base}/landing", str(tmp_path), TARGET, sources=("kev",))
    assert only.kev and not only.silver and only.passed is None


def test_train(run):
    facts = run.metadata
    assert facts["n_features"] == 18 and facts["n_rows_closed"] == DAYS
    assert facts["heldout_window_days"] == 60 and not facts["holdout_leak"]
    assert len(facts["fold_metrics"]) == 2 and set(facts["avg_metrics"]) == {"auc_pr", "auc_roc", "precision_at_k", "brier"}
    assert set(facts["feature_importance"]) == set(facts["feature_names"])
    assert len(facts["heldout_content_sha256"]) == 64


def test_guards(frame):
    with pytest.raises(NotEnoughData, match="right-censoring"):
        train(frame, TRAIN, today=START + timedelta(days=60))
    with pytest.raises(ValueError, match="unsupported strategy"):
        train(frame, TrainConfig(strategy="other"), today=TARGET)
    with pytest.raises(NotEnoughData, match="positives"):
        train(frame.withColumn("exploited_30d", F.lit(False)), TRAIN, today=TARGET)
    with pytest.raises(NotEnoughData, match="f_epss_score"):
        train(frame.drop("f_epss_score"), TRAIN, today=TARGET)


def test_registry_evaluation_and_ablations(spark, frame, run, tmp_path):
    root = str(tmp_path / "registry")
    assert latest_run(spark, root) is None
    with pytest.raises(FileNotFoundError):
        load_latest(spark, root)
    save_run(spark, root, run.model, run.metadata)
    model, facts = load_latest(spark, root)
    assert facts["run_id"] == run.metadata["run_id"]

    report = evaluate_model(frame, model, facts, today=TARGET, config=EVAL)
    rows = {r["model"]: r for r in report.collect()}
    assert set(rows) == {"model", "baseline"} and rows["model"]["status"] == "ok"
    assert rows["model"]["note"] is None and rows["model"]["baseline_coverage"] == 1.0
    assert rows["baseline"]["auc_pr"] == 1.0 and rows["model"]["gate_passed"]
    assert gate(report).first()["passed"]
    changed = {**facts, "heldout_content_sha256": "0" * 64}
    assert "differs" in evaluate_model(frame, model, changed, today=TARGET, config=EVAL).first()["note"]

    table = {r["variant"]: r for r in ablations(frame, model, facts, today=TARGET, config=EVAL).collect()}
    assert set(table) == {"baseline_only", "full", "no_baseline", "complement"}
    assert table["baseline_only"]["auc_pr"] == 1.0 and all(r["note"] is None for r in table.values())


def test_results_without_a_model_or_holdout(frame, run):
    none = evaluate_model(frame, None, None, today=TARGET, config=EVAL)
    assert none.first()["status"] == "unavailable" and not gate(none).first()["passed"]
    early = START + timedelta(days=45)
    sparse = evaluate_model(frame, run.model, run.metadata, today=early, config=EVAL).first()
    assert sparse["status"] == "unavailable" and "minimums" in sparse["reason"]
    assert "minimums" in ablations(frame, run.model, run.metadata, today=early, config=EVAL).first()["note"]
    notes = {r["variant"]: r["note"] for r in ablations(frame, None, None, today=TARGET, config=EVAL).collect()}
    assert notes["complement"] == "no trained model found"


def test_rank(spark, stored, frame, run):
    base, _ = stored
    index = load_product_index(spark, f"{base}/data/bronze/nvd")
    master = spark.read.parquet(f"{base}/data/silver/cve_master")
    body = {
        "bomFormat": "CycloneDX",
        "specVersion": "1.5",
        "components": [{"name": "harbor", "version": "7.4.1", "purl": "pkg:generic/harbor@7.4.1"}],
    }
    docs = spark.createDataFrame([("d", json.dumps(body))], "doc_id string, json string")
    found = rank_documents(docs, master, index=index, predictions=score_frame(frame, run.model))
    ranked, rejects = found.ranked, found.rejects
    rows = ranked.orderBy("rank").collect()
    assert len(rows) == DAYS // 4 and [r["rank"] for r in rows] == list(range(1, DAYS // 4 + 1))
    assert rows[0]["in_kev"] and rows[0]["match_method"] == "product_version_exact"
    assert all(a["probability"] >= b["probability"] for a, b in zip(rows, rows[1:]))
    assert rejects.isEmpty()


def test_greedy_search_prefers_the_first_of_equals():
    gains = {(6, 20): 0.5, (8, 20): 0.5, (12, 20): float("nan"), (6, 50): 0.7, (6, 150): 0.7}
    found = greedy_search(
        BoosterParams(min_instances=20),
        {"max_depth": (6, 8, 12), "min_instances": (20, 50, 150)},
        lambda p: gains[(p.max_depth, p.min_instances)],
    )
    assert (found.max_depth, found.min_instances) == (6, 50)


def test_constant_target(spark):
    rows = assembler(["x"]).transform(spark.createDataFrame([(1.0, 0.5), (2.0, 0.5)], "x double, y double"))
    with pytest.raises(DegenerateTarget):
        fit_booster(rows, None, target="y", params=BOOSTER)


def test_calibration(spark):
    points = [(0.1, 0), (0.2, 1), (0.2, 0), (0.3, 0), (0.6, 1), (0.9, 1)]
    df = spark.createDataFrame(points, "p double, y int")
    probe = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.9, 5.0)], "p double")

    def values(calibrator):
        return [r["calibrated"] for r in calibrator.transform(probe, "p").collect()]

    assert values(fit_calibrator(df, score="p", label="y")) == pytest.approx([0.0, 1 / 3, 1.0, 1.0])
    sigmoid = values(fit_calibrator(df, score="p", label="y", method="sigmoid"))
    assert all(0 < a <= b < 1 for a, b in zip(sigmoid, sigmoid[1:]))
    one = fit_calibrator(df.where("y = 1"), score="p", label="y")
    assert isinstance(one, Calibrator) and values(one) == [0.0, 0.2, 0.9, 1.0]
    with pytest.raises(ValueError, match="unknown"):
        fit_calibrator(df, score="p", label="y", method="other")
