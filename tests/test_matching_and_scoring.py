from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators.match import match_components, product_index
from riskloom.operators import match
from riskloom.session import cut_lineage
from riskloom.operators.score import baseline_lookup, rank_matches, score_ids
from riskloom.plans.ranking import rank_documents
from riskloom.sources.sbom import parse_documents, read_documents


def document(components=(), vulnerabilities=None, **fields):
    body = {"bomFormat": "CycloneDX", "specVersion": "1.5", "components": list(components), **fields}
    if vulnerabilities is not None:
        body["vulnerabilities"] = vulnerabilities
    return json.dumps(body)


def frames(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, json string")


def matches(spark, text, nvd=None):
    made = parse_documents(frames(spark, text))
    index = None
    if nvd is not None:
        table = spark.createDataFrame(nvd, "cve_id string, products array<string>, versions array<string>")
        index = product_index(table)
    rows = match_components(made.components, made.inline, index).collect()
    return sorted((r["purl"], r["cve_id"], r["match_method"], r["match_confidence"]) for r in rows)


LANTERN = {"name": "lantern", "version": "0.9.3", "purl": "pkg:generic/lantern@0.9.3", "bom-ref": "lib"}


def test_inline_match_without_index(spark):
    text = document([LANTERN], [{"id": "cve-2020-7101", "affects": [{"ref": "lib"}, {"ref": "other"}, 5]}, "odd", {"id": "x"}])
    assert matches(spark, text) == [("pkg:generic/lantern@0.9.3", "CVE-2020-7101", "inline_vex", "high")]


def test_exact_version(spark):
    nvd = [("CVE-1", ["Lantern"], ["0.9.3"]), ("CVE-2", ["lantern"], ["0.9.4"])]
    assert matches(spark, document([LANTERN]), nvd) == [
        ("pkg:generic/lantern@0.9.3", "CVE-1", "product_version_exact", "medium")
    ]


def test_differing_version_is_no_match(spark):
    assert matches(spark, document([LANTERN]), [("CVE-1", ["lantern"], ["2.0"])]) == []


@pytest.mark.parametrize("versions", [None, [], [None]])
def test_name_only(spark, versions):
    got = matches(spark, document([{"name": "widget"}]), [("CVE-1", ["widget"], versions)])
    assert got == [("pkg:generic/widget", "CVE-1", "product_name", "low")]
    got = matches(spark, document([LANTERN]), [("CVE-1", ["lantern"], versions)])
    assert [g[2] for g in got] == ["product_name"]


def test_component_without_version_matches_by_name(spark):
    got = matches(spark, document([{"name": "widget"}]), [("CVE-1", ["widget"], ["1.0"])])
    assert [g[2] for g in got] == ["product_name"]


def test_stated_match_wins_and_doubles_collapse(spark):
    text = document([LANTERN, {**LANTERN, "bom-ref": "lib-2"}], [{"id": "CVE-2020-7101", "affects": [{"ref": "lib"}]}])
    nvd = [("CVE-2020-7101", ["lantern", "LANTERN"], ["0.9.3"])]
    assert [g[2] for g in matches(spark, text, nvd)] == ["inline_vex"]


def test_last_component_of_a_ref_is_meant(spark):
    first = {"name": "a", "purl": "pkg:x/a", "bom-ref": "r"}
    second = {"name": "b", "purl": "pkg:x/b", "bom-ref": "r"}
    text = document([first, second], [{"id": "CVE-2020-7101", "affects": [{"ref": "r"}]}])
    assert [g[0] for g in matches(spark, text)] == ["pkg:x/b"]


def test_documents_do_not_mix(spark):
    made = parse_documents(
        frames(spark, document([LANTERN]), document([], [{"id": "CVE-2020-7101", "affects": [{"ref": "lib"}]}]))
    )
    assert match_components(made.components, made.inline, None).count() == 0


def test_components(spark):
    text = document(
        [
            5,
            {"type": "application", "name": "n", "version": "1"},
            {"bom-ref": "pkg:npm/z", "name": "z"},
            {},
        ]
    )
    rows = parse_documents(frames(spark, text)).components.orderBy("pos").collect()
    got = [(r["pos"], r["purl"], r["type"], r["bom_ref"]) for r in rows]
    assert got == [
        (1, "pkg:generic/n@1", "application", "pkg:generic/n@1"),
        (2, "pkg:npm/z", "library", "pkg:npm/z"),
        (3, None, "library", None),
    ]


def test_rejects(spark, tmp_path):
    texts = {
        "SPDX": (json.dumps({"bomFormat": "SPDX"}), "bomFormat is not CycloneDX"),
        "version": (json.dumps({"bomFormat": "CycloneDX"}), "specVersion is missing"),
        "list": (
            json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.5", "components": {"a": 1}}),
            "components is not a list",
        ),
        "array": ("[1]", "not a JSON object"),
        "text": ("hello", "not a JSON object"),
        "broken": ('{"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [ }', "invalid JSON"),
    }
    for name, (text, _) in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "fine").write_text(json.dumps({"bomFormat": "CycloneDX", "specVersion": 1.4, "components": {}}))
    made = parse_documents(read_documents(spark, str(tmp_path)))
    got = {r["doc_id"]: r["reason"] for r in made.rejects.collect()}
    assert got == {name: reason for name, (_, reason) in texts.items()}
    assert made.components.isEmpty()


MASTER = "cve_id string, epss_score float, epss_percentile float, in_kev boolean, cvss_v3_base_score float"


def scored(spark, master, predictions, ids, **kind):
    requests = spark.createDataFrame(list(enumerate(ids)), "pos int, cve_id string")
    known = spark.createDataFrame(master, MASTER)
    made = None
    if predictions is not None:
        made = spark.createDataFrame(predictions, "cve_id string, predicted double")
    rows = score_ids(requests, known, made, **kind).orderBy("pos").collect()
    return [(r["cve_id"], round(r["probability"], 6), round(r["percentile"], 6), r["in_kev"]) for r in rows]


@pytest.mark.parametrize(
    "epss, residual, want",
    [(None, None, 0.0), (0.37, None, 0.37), (0.25, 0.45, 0.7), (0.8, 0.6, 1.0), (0.15, -0.4, 0.0), (1.0, 0.0, 1.0)],
)
def test_blend(spark, epss, residual, want):
    master = [] if epss is None else [("a", epss, 0.9, False, None)]
    predictions = [("other", 0.1)] if residual is None else [("a", residual)]
    got = scored(spark, master, predictions, ["a"])
    assert got == [("a", want, 0.0 if epss is None else 0.9, False)]


def test_probability_model_does_not_add_the_baseline(spark):
    assert scored(spark, [("a", 0.4, 0.5, False, None)], [("a", 0.65)], ["a"], kind="probability")[0][1] == 0.65


def test_order_duplicates_and_unknown_ids(spark):
    master = [("a", 0.6, 0.1, True, 9.0), ("b", 0.05, 0.2, False, None), ("c", None, None, False, None)]
    got = scored(spark, master, [("a", 0.1)], ["b", "a", "unknown", "b", "c"])
    assert got == [
        ("b", 0.05, 0.2, False),
        ("a", 0.7, 0.1, True),
        ("unknown", 0.0, 0.0, False),
        ("b", 0.05, 0.2, False),
        ("c", 0.0, 0.0, False),
    ]
    assert scored(spark, master, None, ["a"])[0][1] == 0.6


def test_baseline_lookup(spark):
    table = spark.createDataFrame([("a", 0.5, 0.6)], "cve_id string, epss_score float, epss_percentile float")
    requests = spark.createDataFrame([("a",), ("b",)], "cve_id string")
    got = {r["cve_id"]: (r["epss_score"], r["known"]) for r in baseline_lookup(requests, table).collect()}
    assert got == {"a": (0.5, True), "b": (0.0, False)}


@pytest.mark.parametrize("slices", [1, 256])
def test_rank_order(spark, slices):
    rows = [
        ("d", "CVE-3", 0.5, 5.0, 2, 0),
        ("d", "CVE-2", 0.5, None, 2, 0),
        ("d", "CVE-1", 0.5, None, 2, 1),
        ("d", "CVE-1", 0.5, None, 1, 4),
        ("d", "CVE-9", 0.9, 1.0, 2, 0),
        ("e", "CVE-1", 0.1, None, 1, 0),
    ]
    df = spark.createDataFrame(
        rows, "doc_id string, cve_id string, probability double, cvss_v3_base_score double, tier int, pos int"
    )
    got = rank_matches(df, slices=slices).orderBy("doc_id", "rank").collect()
    assert [(r["doc_id"], r["rank"], r["cve_id"], r["tier"]) for r in got] == [
        ("d", 1, "CVE-9", 2),
        ("d", 2, "CVE-3", 2),
        ("d", 3, "CVE-1", 1),
        ("d", 4, "CVE-1", 2),
        ("d", 5, "CVE-2", 2),
        ("e", 1, "CVE-1", 1),
    ]


def test_rank_documents(spark):
    docs = frames(spark, document([LANTERN]), document([{"name": "nothing"}]), "bad")
    nvd = spark.createDataFrame(
        [("CVE-1", ["lantern"], ["0.9.3"]), ("CVE-2", ["lantern"], None)],
        "cve_id string, products array<string>, versions array<string>",
    )
    master = spark.createDataFrame([("CVE-2", 0.8, 0.9, True, 7.0)], MASTER)
    found = rank_documents(docs, master, index=product_index(nvd))
    ranked, rejects = found.ranked, found.rejects
    assert not found.degraded and rank_documents(docs, master).degraded
    assert [(r["doc_id"], r["rank"], r["cve_id"], r["in_kev"]) for r in ranked.orderBy("rank").collect()] == [
        ("d0", 1, "CVE-2", True),
        ("d0", 2, "CVE-1", False),
    ]
    assert [r["doc_id"] for r in rejects.collect()] == ["d2"]


def test_lookup_keys_are_stored_with_the_components(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(match, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    rows = [("d", 0, "pkg:generic/Lantern@0.9", "x", None, "r"), ("d", 1, "", "lamp", "2.0", "s")]
    components = spark.createDataFrame(rows, "doc_id string, pos int, purl string, name string, version string, bom_ref string")
    index = spark.createDataFrame([("lantern", "CVE-1", ["0.9"]), ("lamp", "CVE-2", None)], "product string, cve_id string, versions array<string>")
    inline = spark.createDataFrame([], "doc_id string, ref string, cve_id string")
    got = {(r["cve_id"], r["purl"], r["match_method"]) for r in match.match_components(components, inline, index).collect()}
    assert got == {("CVE-1", "pkg:generic/Lantern@0.9", match.EXACT), ("CVE-2", "", match.NAME)}
    assert {"_product", "_version"} <= set(stored[0])


def test_requests_are_read_once(spark):
    requests = spark.range(6).select(F.concat(F.lit("C"), "id").alias("cve_id"), "id")
    master = spark.createDataFrame([("C1", 0.5, 0.5, True, 1.0), ("C2", 0.25, 0.5, False, None), (None, 0.5, 0.5, True, 1.0)], MASTER)
    predictions = spark.createDataFrame([("C2", 0.5), ("C3", 0.125), (None, 0.5), ("C9", 0.5)], "cve_id string, predicted double")
    made = score_ids(requests.unionByName(spark.createDataFrame([(None, 7)], "cve_id string, id bigint")), master, predictions)
    assert {r["id"]: r["probability"] for r in made.collect()} == {0: 0.0, 1: 0.5, 2: 0.75, 3: 0.125, 4: 0.0, 5: 0.0, 7: 0.0}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 1
