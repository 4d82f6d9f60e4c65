from __future__ import annotations

import gzip
import json
from datetime import date

import pytest

from riskloom.operators.flatten import flatten_nvd
from riskloom.plans.ranking import load_product_index
from riskloom.schemas import EPSS_BRONZE, KEV_BRONZE, NVD_BRONZE
from riskloom.session import cut_lineage
from riskloom.sources import bronze, landing
from riskloom.streaming import ingest
from riskloom.streaming.ingest import ingest_scores

D = date


def record(cve="CVE-2024-0001", **fields):
    return {"id": cve, "published": "2024-03-01T10:00:00.000", "lastModified": "2024-03-05T10:00:00.000Z", **fields}


def flat(spark, *records):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    made = flatten_nvd(spark.createDataFrame(texts, "j string"), "j")
    return {r["cve_id"]: r.asDict() for r in made.collect()}


def metric(kind="Primary", key="cvssData", **data):
    return {"type": kind, key: data}


def test_minimal_record(spark):
    row = flat(spark, {"cve": record()})["CVE-2024-0001"]
    assert row["published_date"] == D(2024, 3, 1) and row["last_modified_date"] == D(2024, 3, 5)
    assert row["description"] == "" and row["description_len"] == 0
    assert row["vendor_count"] == row["product_count"] == 0
    assert row["ref_has_exploit"] is False and row["ref_has_patch"] is False
    assert all(row[n] is None for n in ("cwe_ids", "vendors", "products", "versions", "cvss_v3_base_score"))


def test_records_without_required_fields_drop_out(spark):
    got = flat(
        spark,
        record("a", published=None),
        record("b", lastModified="never"),
        record(""),
        "not json",
        "[1]",
        '{"cve": 5, "id": "c"}',
        {"cve": record("d")},
        record("e"),
    )
    assert set(got) == {"d", "e"}


def test_modified_is_never_before_published(spark):
    assert flat(spark, record(lastModified="2023-01-01"))["CVE-2024-0001"]["last_modified_date"] == D(2024, 3, 1)


@pytest.mark.parametrize(
    "metrics, want",
    [
        ({"cvssMetricV31": [metric(baseScore=9.8, baseSeverity="critical", vectorString="v")]}, (9.8, "CRITICAL", "v")),
        (
            {"cvssMetricV31": [metric("Secondary", baseScore=1.0), metric(baseScore=2.5, baseSeverity="Low")]},
            (2.5, "LOW", None),
        ),
        ({"cvssMetricV31": [metric("Secondary", baseScore="3.5")]}, (3.5, None, None)),
        (
            {
                "cvssMetricV31": [metric(baseSeverity="HIGH", vectorString="new")],
                "cvssMetricV30": [metric(baseScore=4.0, vectorString="old")],
            },
            (4.0, None, "old"),
        ),
        ({"cvssMetricV31": [metric(baseSeverity="HIGH", vectorString="new")]}, (None, "HIGH", "new")),
        (
            {"cvssMetricV31": [metric(baseSeverity="HIGH")], "cvssMetricV30": [metric(baseSeverity="LOW")]},
            (None, "LOW", None),
        ),
        ({"cvssMetricV31": [{**metric(baseScore=1), **metric(key="cssvData", baseScore=7)}]}, (7.0, None, None)),
        ({"cvssMetricV31": [metric(baseScore="high")], "cvssMetricV30": []}, (None, None, None)),
    ],
)
def test_score_selection(spark, metrics, want):
    row = flat(spark, record(metrics=metrics))["CVE-2024-0001"]
    got = (row["cvss_v3_base_score"], row["cvss_v3_severity"], row["cvss_v3_vector"])
    assert got[1:] == want[1:] and (got[0] == pytest.approx(want[0]) if want[0] is not None else got[0] is None)


def test_sets_texts_and_flags(spark):
    body = record(
        descriptions=[{"lang": "fr", "value": "x"}, {"lang": "en", "value": "a😀b"}, {"lang": "en", "value": "later"}],
        weaknesses=[
            {"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}]},
            {},
            {"description": [{"value": "CWE-22"}, {"value": "CWE-79"}]},
        ],
        configurations=[
            {"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p:1.0:*"}, {"cpe23Uri": "cpe:2.3:a:v:q:*:*"}, {}]}]},
            {"nodes": None},
            {"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:w:p:-:*"}, {"criteria": "bad"}]}]},
        ],
        references=[{"tags": ["EXPLOIT"]}, {"tags": None}, {}],
    )
    row = flat(spark, body)["CVE-2024-0001"]
    assert row["description"] == "a😀b" and row["description_len"] == 3
    assert row["cwe_ids"] == ["CWE-22", "CWE-79"]
    assert (row["vendors"], row["products"], row["versions"]) == (["v", "w"], ["p", "q"], ["1.0"])
    assert (row["vendor_count"], row["product_count"]) == (2, 2)
    assert row["ref_has_exploit"] is True and row["ref_has_patch"] is False


def test_one_odd_field_does_not_spoil_the_record(spark):
    row = flat(spark, record(references="none", weaknesses=[{"description": [{"value": "CWE-1"}]}]))["CVE-2024-0001"]
    assert row["cwe_ids"] == ["CWE-1"] and row["ref_has_patch"] is False


def test_page_and_line_files(spark, tmp_path):
    records = [record(f"CVE-2024-{i:04d}", descriptions=[{"lang": "en", "value": str(i)}]) for i in range(5)]
    again = record("CVE-2024-0000", descriptions=[{"lang": "en", "value": "again"}])
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.json").write_text(json.dumps({"vulnerabilities": [{"cve": r} for r in records]}, indent=1))
    (tmp_path / "pages" / "b.json").write_text(json.dumps({"vulnerabilities": [again, 5]}))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in [*records, again]))
    for folder, lines in (("pages", False), ("lines", True)):
        got = landing.read_nvd(spark, str(tmp_path / folder), lines=lines)
        assert got.columns == NVD_BRONZE.names
        assert {r["cve_id"]: r["description"] for r in got.collect()} == {f"CVE-2024-{i:04d}": str(i) for i in range(5)}
    (tmp_path / "empty.json").write_text(json.dumps({"vulnerabilities": []}))
    with pytest.raises(landing.FeedError, match="no usable"):
        landing.read_nvd(spark, str(tmp_path / "empty.json"))


def kev_file(tmp_path, payload):
    (tmp_path / "kev.json").write_text(json.dumps(payload))
    return str(tmp_path / "kev.json")


def test_catalog(spark, tmp_path):
    entries = [
        {"cveID": "CVE-1", "dateAdded": "2024-01-05", "dueDate": "soon", "vendorProject": "first"},
        {"cveID": "CVE-1", "dateAdded": "2024-01-01", "vendorProject": "second"},
        {"cveID": "", "dateAdded": "2024-01-01"},
        {"cveID": "CVE-2", "dateAdded": "bad"},
        "odd",
        {"cveID": "CVE-3", "dateAdded": "2024-02-01T00:00", "dueDate": "2024-03-01"},
    ]
    rows = landing.read_kev(spark, kev_file(tmp_path, {"vulnerabilities": entries})).collect()
    got = {r["cve_id"]: (r["vendor_project"], r["date_added"], r["due_date"]) for r in rows}
    assert got == {"CVE-1": ("first", D(2024, 1, 5), None), "CVE-3": (None, D(2024, 2, 1), D(2024, 3, 1))}


@pytest.mark.parametrize("payload", [{}, {"vulnerabilities": 5}, {"vulnerabilities": []}, {"vulnerabilities": [{}]}])
def test_catalog_without_usable_rows(spark, tmp_path, payload):
    with pytest.raises(landing.FeedError):
        landing.read_kev(spark, kev_file(tmp_path, payload))


CSV = "#model_version:v1,score_date:x\n{head}\nCVE-1,0.5,0.9{x}\n\nCVE-2,0.25,0.1{x}\nCVE-1,0.7,0.7{x}\n"


@pytest.mark.parametrize("head, extra", [("cve,epss,percentile", ""), ("CVE,EPSS,Percentile", ""), ("cve,epss,percentile,note", ",n")])
@pytest.mark.parametrize("zipped", [True, False])
def test_score_file(spark, tmp_path, head, extra, zipped):
    text = CSV.format(head=head, x=extra)
    path = tmp_path / f"scores-2024-05-06.csv{'.gz' if zipped else ''}"
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    rows = landing.read_epss_csv(spark, str(path))
    assert rows.columns == EPSS_BRONZE.names
    got = {r["cve_id"]: (r["epss_score"], r["snapshot_date"]) for r in rows.collect()}
    assert got == {"CVE-1": (0.5, D(2024, 5, 6)), "CVE-2": (0.25, D(2024, 5, 6))}
    assert landing.read_epss_csv(spark, str(path), D(2020, 1, 1)).first()["snapshot_date"] == D(2020, 1, 1)


@pytest.mark.parametrize("text", ["", "#only\n", "a,b,c\n1,2,3\n"])
def test_bad_score_file(spark, tmp_path, text):
    path = tmp_path / "scores-2024-05-06.csv"
    path.write_text(text)
    with pytest.raises(landing.FeedError):
        landing.read_epss_csv(spark, str(path))


def scores(spark, *rows):
    return spark.createDataFrame(list(rows), EPSS_BRONZE)


def test_snapshot_choice_and_idempotent_writes(spark, tmp_path):
    path = str(tmp_path / "epss")
    assert bronze.read_epss_history(spark, path).count() == 0
    for day in (1, 2, 2):
        rows = scores(spark, ("CVE-1", day / 10, 0.5, D(2024, 1, day)), ("CVE-2", 0.3, 0.5, D(2024, 1, day)))
        bronze.write_table(rows, path, EPSS_BRONZE, partition_by="snapshot_date")
    history = bronze.read_epss_history(spark, path)
    assert history.count() == 4

    def days(df):
        return {r["snapshot_date"].day for r in df.collect()}

    assert days(bronze.latest_snapshot(history)) == {2}
    assert days(bronze.chosen_snapshot(history, D(2024, 1, 1))) == {1}
    assert days(bronze.chosen_snapshot(history, D(2023, 1, 1))) == {2}
    assert days(bronze.epss_snapshot(history, D(2024, 1, 1))) == {1}
    plan = bronze.epss_snapshot(history, D(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_stream_picks_up_new_files_once(spark, tmp_path):
    land, out, mark = (str(tmp_path / n) for n in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()

    def drop(day, text):
        (tmp_path / "land" / f"s-2024-01-0{day}.csv").write_text(text)

    drop(1, CSV.format(head="cve,epss,percentile", x=""))
    ingest_scores(spark, land, out, mark).awaitTermination()
    drop(2, CSV.format(head="cve,epss,percentile", x=""))
    ingest_scores(spark, land, out, mark).awaitTermination()
    ingest_scores(spark, land, out, mark).awaitTermination()
    got = bronze.read_epss_history(spark, out)
    assert {(r["cve_id"], r["snapshot_date"].day, r["epss_score"]) for r in got.collect()} == {
        ("CVE-1", 1, 0.5),
        ("CVE-2", 1, 0.25),
        ("CVE-1", 2, 0.5),
        ("CVE-2", 2, 0.25),
    }
    assert got.count() == 4
    (tmp_path / "land" / "a-2024-01-01.csv").write_text("cve,epss,percentile\nCVE-0,0.75,0.5\nCVE-1,0.125,0.5\n")
    ingest_scores(spark, land, out, mark).awaitTermination()
    first = {r["cve_id"]: r["epss_score"] for r in bronze.read_epss_history(spark, out).collect() if r["snapshot_date"].day == 1}
    assert first == {"CVE-0": 0.75, "CVE-1": 0.125, "CVE-2": 0.25}


def test_stream_deals_a_day_in_parts_and_stores_no_batch_twice(spark, tmp_path, monkeypatch):
    land, out, mark = (str(tmp_path / n) for n in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()
    want, saved = {}, []
    monkeypatch.setattr(ingest, "PART_ROWS", 20, raising=False)
    monkeypatch.setattr(ingest, "cut_lineage", lambda df: saved.append((made := cut_lineage(df)).count()) or made)
    for run, names in enumerate((("c-2024-01-01", "b-2024-01-02"), ("a-2024-01-01", "d-2024-01-01"))):
        for at, name in enumerate(names):
            ids = [f"CVE-{(i * (at + 3)) % 90}" for i in range(60)] + ["CVE-7"]
            lines = [f"{cve},0.{n + 1:03d},0.{run}{at}" for n, cve in enumerate(ids)]
            (tmp_path / "land" / f"{name}.csv").write_text("\n".join(["cve,epss,percentile", *lines]))
            for n, cve in reversed(list(enumerate(ids))):
                key = (cve, int(name[-2:]))
                want[key] = min(want.get(key, ("z",)), (name, n, float(f"0.{n + 1:03d}")))
        ingest_scores(spark, land, out, mark).awaitTermination()
    got = {(r["cve_id"], r["snapshot_date"].day): round(r["epss_score"], 3) for r in bronze.read_epss_history(spark, out).collect()}
    assert got == {key: value[2] for key, value in want.items()}
    assert bronze.read_epss_history(spark, out).count() == len(want)
    # What a batch puts aside is a row for each file.
    assert saved == [2, 2]


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bronze.read_nvd_bronze(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        bronze.read_kev_bronze(spark, str(tmp_path / "none"))
    assert load_product_index(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="columns missing"):
        bronze.write_table(spark.range(1), str(tmp_path / "x"), KEV_BRONZE)


def test_files_of_different_width_fit_together(spark, tmp_path):
    for since, kind in (("2020", "int"), ("2021", "bigint")):
        rows = spark.createDataFrame([(f"CVE-{since}-1", 5)], f"cve_id string, vendor_count {kind}")
        rows.write.parquet(str(tmp_path / f"since={since}-01-01"))
    got = bronze.read_nvd_bronze(spark, str(tmp_path))
    assert got.schema["vendor_count"].dataType == NVD_BRONZE["vendor_count"].dataType
    assert {(r["cve_id"], r["vendor_count"]) for r in got.collect()} == {("CVE-2020-1", 5), ("CVE-2021-1", 5)}


def test_index_of_inconsistent_or_narrow_tables(spark, tmp_path):
    base = str(tmp_path / "nvd")
    spark.createDataFrame([("a", ["p"])], "cve_id string, products array<string>").write.parquet(f"{base}/since=2020-01-01")
    only_names = load_product_index(spark, base).collect()
    assert [(r["product"], r["cve_id"], r["versions"]) for r in only_names] == [("p", "a", None)]
    spark.createDataFrame([(5, 1)], "cve_id int, products int").write.parquet(f"{base}/since=2021-01-01")
    with pytest.raises(Exception, match="cve_id|products"):
        load_product_index(spark, base).collect()
    spark.createDataFrame([("a",)], "cve_id string").write.parquet(str(tmp_path / "narrow"))
    assert load_product_index(spark, str(tmp_path / "narrow")) is None


def test_baseline_from_feed_columns(spark):
    df = spark.createDataFrame([("a", "0.5", "x"), ("b", "bad", "0.1")], "cve_id string, epss string, percentile string")
    assert [tuple(r) for r in bronze.baseline_from_snapshot(df).collect()] == [("a", 0.5, 0.0)]
