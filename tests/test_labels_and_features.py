from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import tags, temporal
from riskloom.operators.assemble import epss_as_of, epss_current, feature_frame, feature_names
from riskloom.operators.labels import drop_open_rows, label_within_horizon
from riskloom.plans.silver import build_master
from riskloom.schemas import CVE_MASTER, EPSS_BRONZE, KEV_BRONZE

LISTED = date(2019, 3, 20)
KEV = [("CVE-2019-1111", LISTED), ("CVE-2019-2222", date(2019, 11, 5))]


@pytest.mark.parametrize(
    "cve, published, in_kev, label",
    [
        ("CVE-2019-1111", LISTED - timedelta(days=1), True, True),
        ("CVE-2019-1111", LISTED - timedelta(days=30), True, True),
        ("CVE-2019-1111", LISTED - timedelta(days=31), True, False),
        ("CVE-2019-1111", LISTED + timedelta(days=200), True, True),
        ("CVE-2019-2222", date(2019, 1, 7), True, False),
        ("CVE-2018-3333", LISTED, False, False),
    ],
)
def test_label(spark, cve, published, in_kev, label):
    df = spark.createDataFrame([(cve, published)], "cve_id string, published_date date")
    kev = spark.createDataFrame(KEV, "cve_id string, date_added date")
    row = label_within_horizon(df, kev).first()
    assert (row["in_kev"], row["exploited_30d"]) == (in_kev, label)
    assert (row["kev_date_added"] is None) == (not in_kev)


def test_label_names_missing_columns(spark):
    df = spark.createDataFrame([("a",)], "cve_id string")
    with pytest.raises(ValueError, match="published_date"):
        label_within_horizon(df, spark.createDataFrame(KEV, "cve_id string, date_added date"))


def test_censoring(spark):
    today = date(2022, 10, 20)
    ages = (400, 31, 30, 29, 0)
    df = spark.createDataFrame([(today - timedelta(days=a), a) for a in ages], "published_date date, age int")
    assert {r["age"] for r in drop_open_rows(df, today).collect()} == {400, 31, 30}


def master_row(cve, published, **values):
    row = {
        "cve_id": cve,
        "published_date": published,
        "last_modified_date": published,
        "cvss_v3_base_score": 7.5,
        "cvss_v3_severity": "HIGH",
        "cvss_v3_vector": "CVSS:3.1/AV:N/AC:L",
        "cwe_ids": ["CWE-79"],
        "vendor_count": 1,
        "product_count": 1,
        "description_len": 40,
        "ref_has_exploit": False,
        "ref_has_patch": True,
        "epss_score": None,
        "epss_percentile": None,
        "epss_snapshot_date": None,
        "in_kev": False,
        "kev_date_added": None,
        "exploited_30d": False,
    }
    return tuple({**row, **values}[name] for name in CVE_MASTER.names)


FIRST, SECOND, OLD = "CVE-2021-1001", "CVE-2021-1002", "CVE-2020-1003"


@pytest.fixture()
def silver(spark):
    def row(cve, day, tag, score):
        known = {"epss_score": score, "epss_percentile": score / 2, "epss_snapshot_date": date(2021, 9, 20)}
        return master_row(cve, day, cwe_ids=[tag], **known)

    rows = [
        row(FIRST, date(2021, 3, 9), "CWE-416", 0.71),
        row(SECOND, date(2021, 3, 28), "CWE-190", 0.12),
        row(OLD, date(2020, 8, 4), "CWE-190", 0.33),
    ]
    return spark.createDataFrame(rows, CVE_MASTER)


@pytest.fixture()
def history(spark):
    """Two days of scores, one between the publications and one after them all."""
    between, after = date(2021, 1, 5), date(2021, 9, 20)
    rows = [(cve, 0.03 * n, 0.2 * n, between) for n, cve in enumerate((FIRST, SECOND), 1)]
    rows += [(cve, 0.8 + 0.05 * n, 0.7, after) for n, cve in enumerate((FIRST, SECOND, OLD), 1)]
    return spark.createDataFrame(rows, EPSS_BRONZE)


def values(df, name):
    return {r["cve_id"]: r[name] for r in df.collect()}


def test_scores_as_of_publication(silver, history):
    got = values(epss_as_of(silver, history), "f_epss_score")
    assert got == pytest.approx({FIRST: 0.03, SECOND: 0.06, OLD: 0.0})


def test_empty_history_counts_as_none(spark, silver):
    known = silver.withColumn("epss_snapshot_date", F.lit("2021-03-15").cast("date"))
    empty = spark.createDataFrame([], EPSS_BRONZE)
    for history in (None, empty):
        got = values(epss_as_of(known, history), "f_epss_score")
        assert got == pytest.approx({FIRST: 0.0, SECOND: 0.12, OLD: 0.0})


def test_a_repeated_id_sees_no_later_score(spark, history):
    """The score of an id's later row must not reach its earlier one."""
    rows = [(FIRST, date(2021, 3, 9)), (FIRST, date(2021, 10, 1)), (FIRST, None)]
    df = spark.createDataFrame(rows, "cve_id string, published_date date")
    got = {r["published_date"]: r["f_epss_score"] for r in epss_as_of(df, history).collect()}
    assert got == pytest.approx({date(2021, 3, 9): 0.03, date(2021, 10, 1): 0.85, None: 0.0})


def test_scores_without_history_or_columns(spark, silver):
    bare = silver.select("cve_id", "published_date")
    for history in (None, spark.createDataFrame([], EPSS_BRONZE)):
        assert set(values(epss_as_of(bare, history), "f_epss_score").values()) == {0.0}


def test_rows_without_a_date_stay(silver):
    undated = silver.withColumn("published_date", F.when(F.col("cve_id") != OLD, F.col("published_date")))
    got = values(temporal.temporal_per_row(undated), "f_cves_published_same_month")
    assert got == {FIRST: 1, SECOND: 2, OLD: None}


def test_scores_without_history(silver):
    assert set(values(epss_as_of(silver, None), "f_epss_score").values()) == {0.0}
    assert values(epss_current(silver), "f_epss_score")[FIRST] == pytest.approx(0.71)


def test_counts_do_not_see_later_rows(silver):
    own = values(temporal.temporal_per_row(silver), "f_cves_published_same_month")
    fixed = values(temporal.temporal_as_of(silver), "f_cves_published_same_month")
    assert (own[FIRST], fixed[FIRST]) == (1, 2)


def test_popularity_does_not_see_later_rows(silver):
    tagged = tags.explode_tags(silver, key="cve_id", day="published_date", tags="cwe_ids")
    own = values(tags.popularity_per_row(tagged, key="cve_id", day="published_date"), tags.FEATURES[0])
    fixed = values(tags.popularity_as_of(tagged, key="cve_id", day="published_date"), tags.FEATURES[0])
    assert (own[OLD], fixed[OLD]) == (1, 2)


def test_rows_without_tags_count_zero(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), []), ("b", date(2024, 1, 1), None), ("c", date(2024, 1, 1), ["x"])],
        "cve_id string, published_date date, cwe_ids array<string>",
    )
    tagged = tags.explode_tags(df, key="cve_id", day="published_date", tags="cwe_ids")
    for made in (
        tags.popularity_per_row(tagged, key="cve_id", day="published_date"),
        tags.popularity_as_of(tagged, key="cve_id", day="published_date"),
    ):
        assert {r[0]: tuple(r)[1:] for r in made.collect()} == {"a": (0, 0.0, 0), "b": (0, 0.0, 0), "c": (1, 1.0, 1)}


def test_week_at_new_year(spark):
    days = [date(2024, 1, 2), date(2024, 12, 30), date(2025, 1, 1)]
    df = spark.createDataFrame([(str(d), d) for d in days], "cve_id string, published_date date")
    name = "f_cves_published_same_week"
    assert values(temporal.temporal_as_of(df), name) == {"2024-01-02": 2, "2024-12-30": 2, "2025-01-01": 1}
    assert values(temporal.temporal_as_of(df, iso_year=True), name) == {
        "2024-01-02": 1,
        "2024-12-30": 2,
        "2025-01-01": 2,
    }


def test_frame_has_all_families_and_no_nulls(silver, history):
    frame = feature_frame(silver, history=history, include_graph=True)
    assert len(feature_names(frame)) == 21
    assert len(feature_names(frame, without_epss=True)) == 19
    assert not any(v is None for r in frame.collect() for n, v in r.asDict().items() if n.startswith("f_"))


def test_frame_keeps_rows_after_the_anchor(silver):
    frame = feature_frame(silver, point_in_time=False, as_of=date(2021, 3, 9), include_graph=True)
    ages = values(frame, "f_age_days")
    assert ages == {FIRST: 0, SECOND: 0, OLD: 217}
    assert values(frame, "f_cve_year")[SECOND] == 0


def test_master_has_the_contract(spark, silver):
    nvd = silver.drop("epss_score", "epss_percentile", "epss_snapshot_date", "in_kev", "kev_date_added", "exploited_30d")
    kev = spark.createDataFrame([], KEV_BRONZE)
    one = spark.createDataFrame([(FIRST, 0.45, 0.6, date(2021, 5, 2))] * 2, EPSS_BRONZE)
    for epss in (None, one):
        made = build_master(nvd, kev, epss)
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in CVE_MASTER]
        assert made.count() == 3
    scores = values(build_master(nvd, kev, one), "epss_score")
    assert scores[FIRST] == pytest.approx(0.45) and scores[SECOND] is None
    assert made.where(F.col("exploited_30d")).count() == 0
