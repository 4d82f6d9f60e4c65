from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_labels_and_features import master_row

from riskloom.operators.quality import check, master_rules, roll_up, schema_errors, validate
from riskloom.plans.silver import validate_master
from riskloom.schemas import CVE_MASTER

DAY = date(2024, 1, 2)
LOOSE = [f.simpleString().replace(":", " ") for f in CVE_MASTER]


def failed(spark, *rows):
    df = spark.createDataFrame(list(rows), ", ".join(LOOSE))
    return {r["check"]: r["n_bad"] for r in check(df, master_rules()).collect() if not r["passed"]}


def test_good_rows_pass(spark):
    good = [
        master_row("CVE-2024-0001", DAY),
        master_row("CVE-2024-0002", DAY, cwe_ids=None, cvss_v3_base_score=None, cvss_v3_severity=None, epss_score=1.0),
        master_row("CVE-2024-12345", DAY, cwe_ids=[], in_kev=True, kev_date_added=DAY),
    ]
    assert failed(spark, *good) == {}


@pytest.mark.parametrize(
    "values, name",
    [
        ({"published_date": None}, "dates_present"),
        ({"last_modified_date": date(2024, 1, 1)}, "modified_not_before_published"),
        ({"cvss_v3_base_score": 10.5}, "cvss_v3_base_score_range"),
        ({"cvss_v3_base_score": float("nan")}, "cvss_v3_base_score_range"),
        ({"cvss_v3_severity": "NONE"}, "cvss_v3_severity_domain"),
        ({"vendor_count": -1}, "vendor_count_non_negative"),
        ({"product_count": None}, "product_count_non_negative"),
        ({"description_len": -5}, "description_len_non_negative"),
        ({"ref_has_patch": None}, "ref_has_patch_present"),
        ({"exploited_30d": None}, "exploited_30d_present"),
        ({"epss_score": 1.5}, "epss_score_range"),
        ({"epss_percentile": -0.5}, "epss_percentile_range"),
        ({"in_kev": True}, "kev_date_iff_in_kev"),
        ({"kev_date_added": DAY}, "kev_date_iff_in_kev"),
        ({"cwe_ids": ["CWE-1", "CWE-x"]}, "cwe_id_format"),
    ],
)
def test_each_rule(spark, values, name):
    assert failed(spark, master_row("CVE-2024-0001", DAY), master_row("CVE-2024-0002", DAY, **values)) == {name: 1}


def test_key_rules(spark):
    assert failed(spark, master_row("CVE-24-1", DAY)) == {"cve_id_format": 1}
    assert failed(spark, *[master_row("CVE-2024-0001", DAY)] * 3) == {"cve_id_unique": 2}
    assert failed(spark, *[master_row(None, DAY)] * 3) == {"cve_id_format": 3, "cve_id_unique": 2}


def test_parity_is_checked_row_by_row(spark):
    rows = [
        master_row("CVE-2024-0001", DAY, in_kev=True),
        master_row("CVE-2024-0002", DAY, kev_date_added=DAY),
    ]
    assert failed(spark, *rows) == {"kev_date_iff_in_kev": 2}


def test_schema_comes_first(spark):
    df = spark.createDataFrame([master_row("CVE-2024-0001", DAY)], CVE_MASTER)
    assert schema_errors(df, CVE_MASTER) == []
    swapped = df.select(*reversed(df.columns))
    assert len(schema_errors(swapped, CVE_MASTER)) == 1
    wrong = df.withColumn("epss_score", F.col("epss_score").cast("double")).drop("in_kev")
    assert len(schema_errors(wrong, CVE_MASTER)) == 3
    assert {r["check"] for r in validate(wrong, CVE_MASTER, master_rules()).collect()} == {"schema"}


def test_roll_up_and_written_result(spark, tmp_path):
    path, result = str(tmp_path / "silver"), str(tmp_path / "result")
    rows = [master_row("CVE-2024-0001", DAY), master_row("bad", DAY, epss_score=2.0)]
    spark.createDataFrame(rows, CVE_MASTER).write.parquet(path)
    summary = validate_master(spark, path, result).first()
    assert (summary["n_rows"], summary["n_errors"], summary["passed"]) == (2, 2, False)
    assert any("epss_score_range: 1 rows: min=" in e for e in summary["errors"])
    part = next(p for p in (tmp_path / "result").iterdir() if p.suffix == ".json")
    assert json.loads(part.read_text())["n_errors"] == 2
    missing = validate_master(spark, str(tmp_path / "none")).first()
    assert not missing["passed"] and "missing table" in missing["errors"][0]


def test_roll_up_of_a_pass(spark):
    df = spark.createDataFrame([master_row("CVE-2024-0001", DAY)], CVE_MASTER)
    summary = roll_up(validate(df, CVE_MASTER, master_rules()), "t").first()
    assert summary["passed"] and summary["errors"] == [] and summary["n_rows"] == 1
