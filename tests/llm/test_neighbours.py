"""Nearest neighbours against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd

from riskloom.llm import queries
from riskloom.llm.neighbours import BLOCK, nearest


def brute(rows, k, every=20):
    """{query: [(id, score), ...]} of rows (id, vector)."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            scores = (x * x[q]).sum(axis=1)
            order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
            out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def lists(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([tuple(r) for r in table], 20)
    got = lists(queries.op10_nearest_neighbours(spark, folder))
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(v) for q, v in brute([tuple(r) for r in table], 5000).items()}
    assert all(math.isclose(s, exact[q][i], rel_tol=1e-12, abs_tol=1e-15) for q, v in got.items() for i, s in v)


def test_recall_of_uneven_lengths(spark):
    """Clusters of vectors of lognormal length and one that is 10,000 times as long, in ten times as many rows as a block holds."""
    rng = np.random.default_rng(5)
    n, d = 10 * BLOCK, 32
    x = rng.normal(size=(n // 100, d))[rng.integers(0, n // 100, n)] + 0.6 * rng.normal(size=(n, d))
    x *= (rng.lognormal(0, 0.5, n) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= 10_000
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = lists(nearest(table, "id % 40 = 0"))
    hits = []
    for begin in range(0, n, 4096):
        for q in range(-(-begin // 40) * 40, min(begin + 4096, n), 40):
            scores = x @ x[q]
            scores[q] = -np.inf
            want = set(np.argpartition(-scores, 20)[:20].tolist())
            hits.append(len({i for i, _ in got[q]} & want) / 20)
    print("recall", np.mean(hits), "lowest", min(hits))
    assert len(hits) == len(got) and np.mean(hits) >= 0.97 and min(hits) >= 0.5


def test_ties_copies_and_odd_vectors(spark):
    rng = random.Random(4)
    good = [(i, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for i in range(60)]
    good += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(50)] + [(200, [9.0, 0.0, 0.0, 0.0]), (220, [-1.0, 0.0, 0.0, 0.0])]
    nan, inf = float("nan"), float("inf")
    odd = [(300, None), (320, [0.0] * 4), (340, [nan, 1.0, 1.0, 1.0]), (360, [inf, 1.0, 1.0, 1.0]), (380, [None, 1.0, 1.0, 1.0]), (400, [1.0]), (420, []), (None, [1.0] * 4)]
    rows = good + odd + good[:5]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got, want = lists(nearest(table, "id % 20 = 0", k=20)), brute(good, 20)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in found], atol=1e-12)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), "id % 20 = 0").collect() == []
    assert nearest(spark.createDataFrame([(20, [1.0, 2.0])], schema), "id % 20 = 0").collect() == []
    got = lists(nearest(spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])], schema), "id % 20 = 0"))
    assert got == {20: [(1, 3.0), (2, 0.5)]}
