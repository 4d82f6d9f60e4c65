"""Every stage of the pipeline, and the whole, against plain Python on a small corpus with odd rows."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import quality
from riskloom.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, tkey int, _doc int, _key int, offset int, line_nos int"
SAMPLE = "the of a report says that water level river town people market price old new house garden winter summer train".split()


def sentence(rng, n):
    return " ".join(rng.choice(SAMPLE) for _ in range(n))


def corpus(seed):
    """Rows (doc_id, text) with copies, near copies, repeated lines, benchmark passages, nulls and repeated ids."""
    rng = random.Random(seed)
    items = [(f"i{k}", sentence(rng, 14)) for k in range(3)] + [("short", "zebra quagga"), ("none", None), ("blank", " ")]
    common = sentence(rng, 11)
    rows = []
    for i in range(24):
        parts = [sentence(rng, rng.randrange(9, 30)) for _ in range(rng.randrange(1, 4))]
        if i % 5 == 0:
            parts.append(common if i % 2 else common + " more")
        if i % 7 == 0:
            parts.append("}")
        if i % 8 == 3:
            parts.append("see " + items[i % 3][1].upper() + " end")
        rows.append((100 + i, "\n".join(parts)))
    long = sentence(rng, 80)
    rows += [(200, long), (201, long), (202, long + " tail"), (203, "a zebra quagga")]
    rows += [(204, None), (205, ""), (206, "\n\n"), (None, long), (None, None), (100, rows[0][1]), (300, common)]
    return rows, items


def table(spark, rows):
    made = [(d, t, "en", "s", len(t or ""), "r", 1, 2, 3, 4, 5, 6) for d, t in rows]
    return spark.createDataFrame(made, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    rows, items = corpus(1)
    table(spark, rows).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
    labels = [(d, int(i % 3 > 0)) for i, (d, _) in enumerate(rows) if d is not None] + [(100, None), (999, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def plain_lines(rows):
    """Rows after equal lines of any length, and near ones of eight words or more, have gone."""
    seen = []
    for d, t in {(d, t) for d, t in rows if d is not None and t is not None}:
        seen += [(d, i, brute.WORD.findall(line)) for i, line in enumerate(t.split("\n"))]
    seen.sort(key=lambda s: s[:2])
    gone = set()
    for k, (d, i, w) in enumerate(seen):
        if w and any(o == w or (len(w) >= 8 and len(o) >= 8 and brute.edits(w, o) <= 1) for _, _, o in seen[:k]):
            gone.add((d, i))
    out = []
    for d, t in rows:
        if d is None or t is None:
            out.append((d, t))
            continue
        lines = t.split("\n")
        kept = [line for i, line in enumerate(lines) if (d, i) not in gone]
        if len(kept) == len(lines) or brute.WORD.search("\n".join(kept)):
            out.append((d, "\n".join(kept)))
    return out


def plain_near(rows):
    """Rows whose id is the smallest of its group; ids are taken to have one text."""
    known = {d: t for d, t in rows if d is not None}
    groups = brute.components(list(known.items()), 5, 80)
    return [(d, t) for d, t in rows if d is None or groups[d][1] == d]


def plain_benchmark(rows, items):
    return [(d, t) for d, t in rows if brute.contamination([(d, t)], items, 10)[0][2] == 0]


def plain_good(spark, rows, folder):
    scores = quality.quality_scores(table(spark, rows), spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r["doc_id"] for r in scores.where("score < 0.5").collect()}
    found = {(r["doc_id"], r["text_key"]) for r in scores.where("score < 0.5").collect()}
    keyed = table(spark, rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("k")).collect()
    assert bad is not None
    return [(r["doc_id"], r["text"]) for r in keyed if (r["doc_id"], r["k"]) not in found]


def test_quality(spark, folder):
    rows, _ = corpus(1)
    got = corpus_pipeline.quality(spark, table(spark, rows), folder)
    want = plain_good(spark, rows, folder)
    assert pairs(got) == sorted(want, key=str) and 0 < len(want) < len(rows)
    assert got.columns == table(spark, rows).columns and {r["_doc"] for r in got.collect()} == {3}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, folder, seed):
    rows, _ = corpus(seed)
    got = corpus_pipeline.lines(spark, table(spark, rows), folder)
    want = plain_lines(rows)
    assert pairs(got) == sorted(want, key=str) and want != rows
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect()) and {r["line_nos"] for r in got.collect()} == {6}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, folder, seed):
    rows, _ = corpus(seed)
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), folder)
    want = plain_near(rows)
    assert pairs(got) == sorted(want, key=str) and len(want) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_benchmark(spark, folder, seed):
    rows, items = corpus(seed)
    own = spark.createDataFrame(items, "item_id string, text string")
    assert own.count() == 6
    got = corpus_pipeline.benchmark(spark, table(spark, rows), folder)
    want = plain_benchmark(rows, corpus(1)[1])
    assert pairs(got) == sorted(want, key=str) and (seed == 2 or len(want) < len(rows))


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 4096):
            own = ids[start : start + 4096]
            out.append((d, start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()), len(ids)))
    return sorted(out, key=str)


def pieces(df):
    rows = df.collect()
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values(), default=0) <= 4096
    return sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=str)


def test_packing(spark, folder):
    rows, _ = corpus(1)
    rows.append((301, "word " * 9000))
    assert pieces(corpus_pipeline.packing(spark, table(spark, rows), folder)) == plain_pieces(rows)


def test_run(spark, folder):
    rows, items = corpus(1)
    for step in (lambda r: plain_good(spark, r, folder), plain_lines, plain_near, lambda r: plain_benchmark(r, items)):
        rows = step(rows)
    got = corpus_pipeline.run(spark, folder)
    assert pieces(got) == plain_pieces(rows) and len(rows) > 5


def test_stages_pass_on_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    assert corpus_pipeline.packing(spark, docs.limit(0), folder).collect() == []
