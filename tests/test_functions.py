from __future__ import annotations

import math
from urllib.parse import unquote as py_unquote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions.identifiers import component_purl, cpe_parts, cve_id_in, purl_parts
from riskloom.functions.scalars import clamp01, iso_date, iso_weekday, set_or_null, unquote
from riskloom.operators.metrics import calibration_bin

CHECK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def results(spark, values, expression, dtype="string"):
    rows = column(spark, values, dtype).select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


PURLS = {
    "pkg:pypi/foo@1.2.3": ("pypi", None, "foo", "1.2.3"),
    "pkg:npm/bar": ("npm", None, "bar", None),
    "not-a-purl": (None, None, None, None),
    "pkg:maven/org.apache.commons/commons-lang3@3.12.0": ("maven", "org.apache.commons", "commons-lang3", "3.12.0"),
    "pkg:npm/%40babel/core@7.20.0": ("npm", "@babel", "core", "7.20.0"),
    "pkg:deb/debian/curl@7.50.3-1?arch=i386&distro=jessie#a/b": ("deb", "debian", "curl", "7.50.3-1"),
    "pkg:npm/@scope/x": (None, None, None, None),
    "pkg:golang/a/b/c%2Fd@v1%2B2": ("golang", "a/b", "c/d", "v1+2"),
    "pkg:x/a+b%zz": ("x", None, "a+b%zz", None),
    "pkg:x//@2%2B": ("x", None, None, "2%2B"),
    None: (None, None, None, None),
}


def test_purl_parts(spark):
    got = results(spark, list(PURLS), purl_parts)
    assert [tuple(r) for r in got] == list(PURLS.values())


def test_cpe_parts(spark):
    cases = {
        "cpe:2.3:a:openssl:openssl:3.0.0:*": ("openssl", "openssl", "3.0.0"),
        "cpe:2.3:a:v:p:*:*": ("v", "p", None),
        "cpe:2.3:a:v:p:-:*": ("v", "p", None),
        "cpe:2.3:a:v:p": ("v", "p", None),
        "cpe:2.3:a::p:1": (None, "p", "1"),
        "cpe:2.3:a:v": (None, None, None),
        "other:2.3:a:v:p:1": (None, None, None),
        None: (None, None, None),
    }
    assert [tuple(r) for r in results(spark, list(cases), cpe_parts)] == list(cases.values())


def test_cve_id_in(spark):
    cases = {"cve-2024-0001": "CVE-2024-0001", "x CVE-2024-123456 y": "CVE-2024-123456", "CVE-2024-12": None, None: None}
    assert results(spark, list(cases), cve_id_in) == list(cases.values())


def test_component_purl(spark):
    rows = spark.createDataFrame(
        [("p", "r", "n", "1"), ("", "pkg:a/b", "n", "1"), (None, "r", "n", "1"), (None, None, "n", ""), (None, "r", "", "1")],
        "p string, b string, n string, v string",
    )
    got = [r[0] for r in rows.select(component_purl(*[F.col(c) for c in "pbnv"])).collect()]
    assert got == ["p", "pkg:a/b", "pkg:generic/n@1", "pkg:generic/n", None]


def test_iso_date_keeps_the_wall_clock_day(spark):
    cases = {
        "2024-02-29T23:59:59.999Z": "2024-02-29",
        "2024-01-01T00:00:00+09:00": "2024-01-01",
        "2024-13-01": None,
        "soon": None,
        "": None,
        None: None,
    }
    got = results(spark, list(cases), iso_date)
    assert [d and d.isoformat() for d in got] == list(cases.values())


def test_iso_weekday(spark):
    days = ["2024-01-01", "2024-01-07"]
    assert results(spark, days, lambda c: iso_weekday(c.cast("date"))) == [1, 7]


def test_clamp01(spark):
    values = [-0.5, 0.25, 1.5, None, math.nan, math.inf]
    assert results(spark, values, clamp01, "double") == [0.0, 0.25, 1.0, 0.0, 0.0, 1.0]


def test_set_or_null(spark):
    values = [["b", "a", "b"], [], None]
    assert results(spark, values, set_or_null, "array<string>") == [["a", "b"], None, None]


@CHECK
@given(st.lists(st.text(st.sampled_from("z%205+/ "), max_size=8), min_size=1, max_size=30))
def test_unquote_like_python(spark, values):
    want = [py_unquote(v) for v in values]
    got = results(spark, values, unquote)
    # The alphabet only spells ASCII escapes, so no invalid UTF-8 can arise.
    assert got == want


@pytest.mark.parametrize("bins", [10, 7, 15])
def test_calibration_bin_follows_the_edges(spark, bins):
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    near = [min(1.0, max(0.0, math.nextafter(e, d))) for e in edges for d in (-1.0, 2.0)]
    values = sorted({*edges, *near, 0.3, 0.7})
    want = [max(i for i in range(bins) if v >= edges[i]) for v in values]
    assert results(spark, values, lambda c: calibration_bin(c, bins), "double") == want
