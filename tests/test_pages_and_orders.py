"""Page files by byte range, orders that no task sorts whole, and the two-key product index."""

from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom.operators.holdout import ordered_split
from riskloom.operators.match import EXACT, NAME, index_matches, product_index
from riskloom.operators.ordering import at_or_before, number_along, order_statistic
from riskloom.operators.score import rank_matches
from riskloom.plans.ingest import daily_ingest
from riskloom.sources import landing, pages
from riskloom.sources.landing import read_kev, read_nvd
from riskloom.sources.pages import page_records


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(['}', '{"', '\\', '\\"}', 'a "vulnerabilities": [{"x": 1}]', "é\n\t", "[", "]}", "", "日本 }{"])
    if kind < 5:
        return rng.choice([1, -2.5, None, True])
    if kind == 5:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "cve", "vulnerabilities", '}"{', "n"]): odd_value(rng, depth + 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("indent", [None, 1])
def test_records_are_those_of_the_whole_file(spark, tmp_path, small_ranges, indent):
    rng = random.Random(3)
    want = []
    for n in range(4):
        records = [{"id": f"{n}-{i}", "v": odd_value(rng), "w": {"x": odd_value(rng)}} for i in range(30)]
        body = {"total": 3, "note": 'x "vulnerabilities": [{', "meta": {"a": {"b": []}, "list": [{"c": 1}]}}
        if n != 2:
            body["before"] = [{"id": "no"}, {"id": "neither"}]
        body["vulnerabilities"] = ["a scalar }", 5, *records[:10], None, *records[10:]]
        body["after"] = [{"id": "nor this"}, {"vulnerabilities": [{"id": "deep"}]}]
        (tmp_path / f"p{n}.json").write_text(json.dumps(body, indent=indent, ensure_ascii=n % 2 == 0))
        want += [(f"p{n}.json", r) for r in records]
    found = page_records(spark, str(tmp_path))
    rows = found.orderBy("_file", "_pos").collect()
    assert [(r["_file"], json.loads(r["_json"])) for r in rows] == want
    scanned = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert scanned > 8


def test_odd_page_files(spark, tmp_path, small_ranges):
    texts = {
        "cut": '{"vulnerabilities": [{"a": 1}, {"a": {"b": 2}}, {"a": "x',
        "none": "no json at all",
        "empty": "",
        "list": '{"vulnerabilities": []}',
        "other": '{"others": [{"a": 9}]}',
        "tight": '{"vulnerabilities":[{},{"a":[]}]}',
        "padded": '\n {"vulnerabilities"\n:\n[\n{"a": 3}\n]\n}\n\n',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for r in page_records(spark, str(tmp_path)).orderBy("_pos").collect():
        got.setdefault(r["_file"].removesuffix(".json"), []).append(json.loads(r["_json"]))
    assert got == {"cut": [{"a": 1}, {"a": {"b": 2}}], "tight": [{}, {"a": []}], "padded": [{"a": 3}]}


def test_feeds_read_by_range_are_the_same(spark, tmp_path, small_ranges):
    records = [
        {"cve": {"id": f"CVE-2020-{7000 + i % 40}", "published": "2020-01-02T00:00:00", "lastModified": "2020-02-02T00:00:00", "descriptions": [{"lang": "en", "value": f"}} no {i} {{"}]}}
        for i in range(50)
    ]
    marks = [{"cveID": f"CVE-2020-{7000 + i}", "dateAdded": "2020-02-03", "notes": '"}'} for i in range(30)]
    for name, own in (("nvd", records), ("kev", marks)):
        (tmp_path / name).mkdir()
        for part in range(2):
            (tmp_path / name / f"{part}.json").write_text(json.dumps({"vulnerabilities": own[part::2]}))
    for read, name in ((read_nvd, "nvd"), (read_kev, "kev")):
        path = str(tmp_path / name)
        assert sorted(map(str, read(spark, path, split_pages=True).collect())) == sorted(map(str, read(spark, path).collect()))


@pytest.mark.parametrize("bits", [0, 2])
def test_a_byte_range_is_cut_into_short_ranges(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(pages, "SLICE_BITS", bits)
    rng = random.Random(5)
    want = [{"id": i, "v": odd_value(rng)} for i in range(40)]
    for name, own in (("a", want[:15]), ("b", want[15:])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"vulnerabilities": own, "after": [{"id": 0}]}))
    rows = page_records(spark, str(tmp_path)).orderBy("_file", "_pos").collect()
    assert [json.loads(r["_json"]) for r in rows] == want


def test_the_daily_batch_reads_no_page_whole(spark, tmp_path, monkeypatch):
    record = {"cve": {"id": "CVE-2020-7001", "published": "2020-01-02T00:00:00", "lastModified": "2020-02-02T00:00:00"}}
    for name, own in (("nvd/2020-01-01", record), ("kev/k", {"cveID": "CVE-2020-7001", "dateAdded": "2020-02-03"})):
        path = tmp_path / "landing" / f"{name}.json"
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps({"vulnerabilities": [own]}))
    read = []
    monkeypatch.setattr(landing, "page_records", lambda spark, path: read.append(path) or page_records(spark, path))
    daily_ingest(spark, str(tmp_path / "landing"), str(tmp_path / "data"), date(2020, 3, 1), nvd_since=date(2020, 1, 1), sources=("nvd", "kev"))
    assert len(read) == 2
    assert spark.read.parquet(str(tmp_path / "data/silver/cve_master")).select("cve_id", "in_kev").collect() == [("CVE-2020-7001", True)]


# -- orders


def test_numbers_along_an_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), 0.5 if rng.random() < 0.8 else rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {(r["g"], r["i"]): r["position"] for r in number_along(df, [F.col("v").desc(), F.col("i").asc()], groups=["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))
    assert number_along(df.limit(0), [F.col("i").asc()], groups=["g"]).collect() == []


def test_one_document_of_equal_probabilities_is_spread(spark):
    n = 2000
    rows = [("d", f"C{i:05d}", 0.5, None, 1, 0) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, cve_id string, probability double, cvss_v3_base_score double, tier int, pos int").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_matches(df)
        sizes = ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["cve_id"] for r in ranked.orderBy("rank").collect()] == [r[1] for r in rows]
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < n


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(["x", "y", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    low = lambda v: (v is not None, v or ("" if isinstance(v, str) else 0))
    want = sorted(rows, key=lambda r: (low(r[0]), (r[1] is not None, r[1] or ""), r[2]))
    for place in (1, 2, 57, 120, 200):
        found = order_statistic(df, place, ["a", "b", "c"])
        assert tuple(found) == want[place - 1]
        flagged = {r["c"] for r in df.where(at_or_before(found, ["a", "b", "c"], df.schema)).collect()}
        assert flagged == {r[2] for r in want[:place]}
    assert order_statistic(df, 201, ["a", "b", "c"]) is None


@pytest.mark.parametrize("n, share", [(100, 0.8), (8, 0.8), (30, 0.01)])
def test_the_split_sorts_no_rows(spark, n, share):
    rows = [(f"2020-01-0{1 + (i * 7) % 3}", f"id{i:03d}") for i in range(n)]
    df = spark.createDataFrame(rows, "d string, id string").select(F.to_date("d").alias("published_date"), F.col("id").alias("cve_id"))
    split = ordered_split(df, train_share=share)
    cut = max(10, int(n * share))
    want = {r[1] for r in sorted(rows)[:cut]}
    assert {r["cve_id"] for r in split.where("is_train").collect()} == want
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Exchange" not in plan


# -- products


def test_versions_are_looked_up_with_the_name(spark):
    nvd = [
        ("C1", ["Lib", "lib", "LIB"], ["1.0", "2.0"]),
        ("C2", ["lib"], None),
        ("C3", ["lib"], []),
        ("C4", ["lib"], ["9.9", None]),
        ("C5", ["lib", None], [None]),
        ("C6", None, ["1.0"]),
    ] + [(f"H{i}", ["lib"], [f"3.{i}"]) for i in range(300)]
    index = product_index(spark.createDataFrame(nvd, "cve_id string, products array<string>, versions array<string>"))
    assert index.where("cve_id = 'C1'").count() == 1
    parts = [("d", 0, None, "LIB", "1.0"), ("d", 1, None, "lib", None), ("d", 2, "pkg:generic/lib@7", "x", None), ("d", 3, None, "none", "1.0")]
    components = spark.createDataFrame(parts, "doc_id string, pos int, purl string, name string, version string")
    found = index_matches(components, index)
    got = {(r["pos"], r["cve_id"], r["match_method"]) for r in found.collect()}
    bare = {f"H{i}" for i in range(300)} | {"C1", "C2", "C3", "C4", "C5"}
    want = {(0, "C1", EXACT), *((0, c, NAME) for c in ("C2", "C3", "C5")), *((1, c, NAME) for c in bare), *((2, c, NAME) for c in ("C2", "C3", "C5"))}
    assert got == want
