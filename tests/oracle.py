"""Compares queries with their SQL in DuckDB: columns by name, rows as sorted text."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def crossing_plan(frame) -> str | None:
    """A join in the plan that compares every row with every other, or ``None``."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return next((j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan), None)


def differences(spark: SparkSession, con, folder: str, query, sql: str) -> str | None:
    """A short description of the first difference, or ``None``."""
    frame = query(spark, folder)
    if crossing := crossing_plan(frame):
        return f"the plan has a {crossing}"
    got_names, got = _rows(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_names, want = _rows(names, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} expected; e.g. {got[:1]} / {want[:1]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ; got {wrong[0][0]}, want {wrong[0][1]} ({got_names})"
    return None
