"""Bucketed histories, published versions, the incremental master table and the registry's latest run."""

from __future__ import annotations

import json
import re
from datetime import date, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators.asof import asof_lookup
from riskloom.plans import incremental
from riskloom.plans.silver import build_master
from riskloom.schemas import CVE_MASTER, EPSS_BRONZE
from riskloom.sources import buckets, files, registry, versioned

DAY = date(2022, 5, 1)


def scores(spark, rows):
    made = [(f"CVE-2022-{i}", float(s), float(s) / 2, DAY + timedelta(days=d)) for i, d, s in rows]
    return spark.createDataFrame(made, EPSS_BRONZE)


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert not files.exists(spark, path) and files.names(spark, f"{tmp_path}/a") == []
    assert files.write_text(spark, path, "é 1") and not files.write_text(spark, path, "2")
    assert files.read_text(spark, path) == "é 1" and files.names(spark, f"{tmp_path}/a") == ["b.json"]
    assert files.write_text(spark, path, "3", replace=True) and files.read_text(spark, path) == "3"
    assert 0 <= files.age_seconds(spark, path) + 1 < 3600
    assert files.rename(spark, path, f"{tmp_path}/a/c.json") and not files.exists(spark, path)
    files.remove(spark, f"{tmp_path}/a")
    assert not files.exists(spark, f"{tmp_path}/a")


# -- buckets


def test_a_bucketed_history_is_not_shuffled(spark, tmp_path):
    path = f"{tmp_path}/history"
    buckets.store_history(scores(spark, [(i, d, i + d) for i in range(40) for d in range(5)]), path, buckets=8)
    whole = buckets.store_history(scores(spark, [(i, 9, 1) for i in range(40)] + [(3, 9, 2), (3, 9, 0)]), path, buckets=8)
    assert whole.count() == 240 and whole.where("cve_id = 'CVE-2022-3' and epss_score = 2").count() == 1
    left = spark.createDataFrame([(f"CVE-2022-{i}", DAY + timedelta(days=i % 12)) for i in range(50)], "cve_id string, day date")
    found = asof_lookup(
        left.hint("merge"), whole, on="cve_id", left_time="day", right_time="snapshot_date", values={"s": "epss_score"}, matched="at", right_unique=True
    )
    got = {r["cve_id"]: (r["s"], r["at"]) for r in found.collect()}
    for i in range(50):
        asked = i % 12
        days = [d for d in (*range(5), 9) if d <= asked] if i < 40 else []
        want = ((2.0 if i == 3 else 1.0) if days[-1] == 9 else float(i + days[-1]), DAY + timedelta(days=days[-1])) if days else (None, None)
        assert got[f"CVE-2022-{i}"] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(part for part in re.split(r"\n(?=[^\n]*Exchange )", plan) if "Bucketed: true" in part)
    above = plan[: plan.index(scan)].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    over, low = [], depth(at)
    for line in reversed(plan[: plan.index(at)].splitlines()):
        if depth(line) < low:
            over.append(line)
            low = depth(line)
    first_join = next(i for i, line in enumerate(over) if "Join" in line)
    assert above is not None and not any("Exchange" in line for line in over[:first_join]), plan


def test_another_session_opens_the_buckets(spark, tmp_path):
    path = f"{tmp_path}/history"
    buckets.store_history(scores(spark, [(1, 0, 1), (2, 0, 2)]), path, buckets=4)
    spark.sql(f"DROP TABLE {buckets._table_name(path)}")
    assert buckets.read_history(spark, path).count() == 2
    spark.sql(f"DROP TABLE {buckets._table_name(path)}")
    assert buckets.store_history(scores(spark, [(1, 1, 5)]), path, buckets=99).count() == 3
    assert json.loads(files.read_text(spark, f"{path}.buckets.json"))["buckets"] == 4


def test_history_rows_without_id_or_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/history"
    loose = spark.createDataFrame([(None, 1.0, 1.0, DAY), ("CVE-2022-1", 1.0, 1.0, None)], "cve_id string, epss_score float, epss_percentile float, snapshot_date date")
    assert buckets.store_history(loose, path, buckets=4).count() == 0
    assert buckets.store_history(scores(spark, [(1, 0, 1)]), path).count() == 1


# -- versions


TABLE = "cve_id string, n int"


def contract(spark):
    return spark.createDataFrame([], TABLE).schema


def rows(spark, pairs):
    return spark.createDataFrame(pairs, TABLE)


def content(spark, root, version=None):
    return {r["cve_id"]: r["n"] for r in versioned.read_table(spark, root, contract(spark), version=version).collect()}


def test_an_upsert_touches_the_buckets_of_its_ids(spark, tmp_path):
    root, shape = f"{tmp_path}/t", contract(spark)
    assert content(spark, root) == {}
    with pytest.raises(FileNotFoundError):
        versioned.upsert(spark, root, rows(spark, [("a", 1)]), shape)
    first = {f"id{i}": i for i in range(60)}
    assert versioned.replace_table(spark, root, rows(spark, list(first.items())), shape, key="cve_id", buckets=16) == 1
    changes = rows(spark, [("id3", 300), ("new", 7)])
    touched = {str(r[0]) for r in changes.select(versioned.bucket_of("cve_id", 16)).collect()}
    assert versioned.upsert(spark, root, changes, shape) == 2
    old, new = versioned.read_version(spark, root, 1)["folders"], versioned.read_version(spark, root)["folders"]
    assert {b for b in new if new[b] != old.get(b)} == touched
    assert content(spark, root) == {**first, "id3": 300, "new": 7} and content(spark, root, 1) == first
    assert versioned.upsert(spark, root, rows(spark, []), shape) == 2


def test_a_run_that_dies_before_it_publishes_changes_nothing(spark, tmp_path, monkeypatch):
    root, shape = f"{tmp_path}/t", contract(spark)
    versioned.replace_table(spark, root, rows(spark, [("a", 1), ("b", 2)]), shape, key="cve_id", buckets=4)

    def dies(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(versioned, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert(spark, root, rows(spark, [("a", 9)]), shape)
    assert content(spark, root) == {"a": 1, "b": 2}
    with monkeypatch.context() as patch:  # after the claim, before the pointer
        patch.setattr(versioned, "rename", dies)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert(spark, root, rows(spark, [("a", 9)]), shape)
    assert content(spark, root) == {"a": 1, "b": 2}
    with pytest.raises(versioned.Conflict):
        versioned.upsert(spark, root, rows(spark, [("a", 9)]), shape)
    facts = versioned.read_version(spark, root)
    assert versioned.publish(spark, root, 1, facts, stale_seconds=-5) == 2 and content(spark, root) == {"a": 1, "b": 2}


def test_of_two_writers_one_publishes(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert versioned.publish(spark, root, 0, {"x": 1}) == 1
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, root, 0, {"x": 2})
    assert versioned.read_version(spark, root)["x"] == 1
    versioned.publish(spark, root, 1, {"x": 3})
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, root, 1, {"x": 4})


# -- the master table


def nvd_rows(spark, pairs):
    defaults = {"cvss_v3_base_score": 5.0, "cvss_v3_severity": "LOW", "cvss_v3_vector": None, "cwe_ids": ["CWE-1"], "vendor_count": 1}
    defaults |= {"product_count": 1, "ref_has_exploit": False, "ref_has_patch": True}
    shape = CVE_MASTER[:12]
    made = [{**defaults, "cve_id": f"CVE-2022-{i}", "published_date": DAY, "last_modified_date": DAY, "description_len": n} for i, n in pairs]
    return spark.createDataFrame([tuple(r[name] for name in shape.names) for r in made], shape)


def marks(spark, pairs):
    return spark.createDataFrame([(f"CVE-2022-{i}", DAY + timedelta(days=d)) for i, d in pairs], "cve_id string, date_added date")


def as_set(df):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_the_master_table_follows_what_changed(spark, tmp_path):
    root = f"{tmp_path}/master"
    everything = [(i, 10) for i in range(30)]
    first_kev, first_scores = marks(spark, [(1, 3), (2, 50)]), scores(spark, [(i, 0, i / 100) for i in range(20)])
    assert incremental.update_master(spark, root, nvd_rows(spark, everything), first_kev, first_scores, buckets=8) == 1
    # An unchanged run publishes nothing, even if rows land again.
    assert incremental.update_master(spark, root, nvd_rows(spark, everything[:4]), first_kev, first_scores) == 1
    kev, snapshot = marks(spark, [(1, 1), (4, 9)]), scores(spark, [(i, 0, i / 100) for i in range(19)] + [(25, 0, 0.5)])
    landed = nvd_rows(spark, [(7, 99), (40, 5)])
    assert incremental.update_master(spark, root, landed, kev, snapshot) == 2
    after = {**dict(everything), 7: 99, 40: 5}
    assert as_set(incremental.read_master(spark, root)) == as_set(build_master(nvd_rows(spark, list(after.items())), kev, snapshot))
    changed = {f"CVE-2022-{i}" for i in (1, 2, 4, 7, 19, 25, 40)}
    touched = {str(r[0]) for r in spark.createDataFrame([(c,) for c in changed], "c string").select(versioned.bucket_of("c", 8)).collect()}
    old, new = (versioned.read_version(spark, root, v)["folders"] for v in (1, 2))
    assert {b for b in new if new[b] != old.get(b)} == touched and len(touched) < 8
    assert incremental.update_master(spark, root, None, kev, None) == 3
    assert incremental.read_master(spark, root).where("epss_score is not null").count() == 0
    with pytest.raises(ValueError):
        incremental.update_master(spark, f"{tmp_path}/other", None, kev, None)


def test_scores_and_marks_are_told_apart_once(spark):
    stored = build_master(nvd_rows(spark, [(i, 10) for i in range(6)]), marks(spark, [(1, 3)]), scores(spark, [(i, 0, 0.5) for i in range(4)]))
    kev, epss = marks(spark, [(1, 3), (1, 2), (3, 1), (3, 9)]), scores(spark, [(0, 0, 0.5), (1, 0, 0.5), (2, 1, 0.25), (2, 0, 0.75), (3, 0, 0.5)])
    landed = nvd_rows(spark, [(4, 11), (5, 10), (8, 1)])
    rows = incremental.changed_rows(stored, landed, kev, epss)
    everything = nvd_rows(spark, [(i, 11 if i == 4 else 10) for i in range(6)] + [(8, 1)])
    assert as_set(rows) == as_set(build_master(everything, kev, epss)) - as_set(stored)
    assert {r["cve_id"][-1] for r in rows.collect()} == set("12348")
    # What is left to do after that sorts neither by day again.
    plan = incremental.changed_rows(spark.createDataFrame(stored.collect(), stored.schema), landed, kev, epss)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


# -- the registry


def facts(name, when, value):
    return {"run_id": name, "model_version": "v", "strategy": "s", "trained_at": when, "value": value}


def test_one_latest_run(spark, tmp_path, monkeypatch):
    root, model = f"{tmp_path}/registry", PipelineModel([])
    registry.save_run(spark, root, model, facts("run-b", "2024-01-02", 1))
    # An older run, and one of the same time with a smaller id, are kept without becoming the latest.
    registry.save_run(spark, root, model, facts("run-z", "2024-01-01", 2))
    registry.save_run(spark, root, model, facts("run-a", "2024-01-02", 3))
    assert registry.latest_run(spark, root)["run_id"] == "run-b" and registry.runs(spark, root).count() == 3
    registry.save_run(spark, root, model, facts("run-b", "2024-01-02", 4))
    assert registry.latest_run(spark, root)["value"] == 4 and registry.runs(spark, root).count() == 3

    # Another writer publishes between the look at the newest version and the claim.
    honest, calls = registry.publish, []

    def late(spark_, root_, base, facts_):
        if not calls:
            calls.append(base)
            honest(spark_, root_, base, {**facts_, "run_id": "run-c", "trained_at": "2024-01-03"})
        return honest(spark_, root_, base, facts_)

    monkeypatch.setattr(registry, "publish", late)
    monkeypatch.setattr(registry, "WAIT_SECONDS", 0)
    registry.save_run(spark, root, model, facts("run-d", "2024-01-03", 5))
    assert registry.latest_run(spark, root)["run_id"] == "run-d" and versioned.latest_version(spark, root) == 4


def test_scores_without_a_history_keep_their_own(spark):
    from riskloom.operators.assemble import epss_as_of

    kev = marks(spark, [])
    master = build_master(nvd_rows(spark, [(1, 1)]), kev, scores(spark, [(1, 0, 0.5)]))
    none = spark.createDataFrame([], EPSS_BRONZE)
    assert epss_as_of(master, none).select(F.round("f_epss_score", 3)).first()[0] == 0.5
