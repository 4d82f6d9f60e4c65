"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

Each text gives about twenty statistics. Cosines of random projections of them approximate a Gaussian kernel. Every
partition of the labelled rows adds up its part of the normal equations, the parts are summed by Spark, and only the sum
(the square of the number of features) comes to the driver. A part of the labelled rows is left out of the fit; pooled
neighbours of their scores give the share of good documents at each score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import text_key, without
from riskloom.llm.storage import stored
from riskloom.llm.wordhash import Words, run_hashes, word_groups

FEATURES = 256
WIDTH = 6.0
RIDGE = 1.0
BINS = 512

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 97:123] = True
_CLASS[2, 48:58] = True
_CLASS[3, [ord(c) for c in ".,;:?'\"-()"]] = True
_CLASS[4, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"]] = True
_CLASS[5, [32, 9]] = True
_CLASS[6, 10] = True
_CLASS[7, 128:] = True


def _share_distinct(hashes: np.ndarray, of: np.ndarray, texts: int, total: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts) / total


def statistics(words: Words) -> np.ndarray:
    """A row of statistics for each text; texts without words have zeros for shares of words."""
    texts, data = len(words.offsets) - 1, words.data
    size = np.maximum(np.diff(words.offsets), 1)
    chars = np.stack([np.diff(np.append(0, np.cumsum(c[data]))[words.offsets]) for c in _CLASS], axis=1) / size[:, None]
    count = np.diff(words.first)
    total = np.maximum(count, 1)
    of = np.repeat(np.arange(texts), count)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(of, length, texts) / total
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, texts) / total - mean**2, 0))
    pair = run_hashes(words.hash, 2)
    same_text = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    repeat = (words.hash[1:] == words.hash[:-1]) & same_text
    last = data[words.end - 1] if len(of) else np.zeros(0, np.uint8)
    first = data[words.start] if len(of) else last
    by_word = [
        np.bincount(of, x, texts) / total
        for x in (_CLASS[4][last], _CLASS[3][last], _CLASS[0][last], _CLASS[0][first], _CLASS[4][first], length == 1, length > 20, last == first)
    ]
    pairs = np.maximum(count - 1, 1)
    distinct = [
        _share_distinct(words.hash, of, texts, total),
        _share_distinct(pair[same_text], of[1:][same_text], texts, pairs) if len(pair) else np.zeros(texts),
        np.bincount(of[1:][repeat], minlength=texts) / pairs if len(of) > 1 else np.zeros(texts),
    ]
    return np.column_stack([chars, np.log1p(count), mean, spread, *by_word, *distinct, np.log1p(count) * distinct[0]])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, words in word_groups(batch.column(2)):
            x = statistics(words).astype(np.float32)
            width = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            columns = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.ListArray.from_arrays(width, pa.array(x.ravel()))]
            yield pa.record_batch(columns, names=["doc", "tkey", "x"])


@dataclass(frozen=True)
class QualityModel:
    """Everything a score is made of; a few hundred kilobytes, whatever the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        waves = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([np.ones(len(z)), waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.shares), 0, 1)


def pooled_neighbours(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: the closest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``tkey`` and ``x``, the statistics, of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_statistics, "doc long, tkey long, x array<float>"), "statistics")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def fit_quality(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> QualityModel | None:
    """The model of rows (``x``, ``y``, ``calibrate``); None without rows to fit or to calibrate on."""
    seen = labelled.filter(~F.col("calibrate"))
    dims = seen.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not dims or not labelled.filter("calibrate").head(1):
        return None
    random = np.random.default_rng(seed)
    blank = QualityModel(
        np.array([d["m"] for d in dims]),
        np.maximum([d["s"] for d in dims], 1e-6),
        random.normal(size=(len(dims), features)) / width,
        random.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.zeros(1),
        np.zeros(1),
    )

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for frame in frames:
            if len(frame):
                f = blank.features(_matrix(frame["x"]))
                total += f.T @ np.column_stack([f, frame["y"].to_numpy(float)])
        yield pd.DataFrame({"row": range(features + 1), "part": list(total)})

    parts = seen.select("x", "y").mapInPandas(equations, "row int, part array<double>")
    sums = parts.select("row", F.posexplode("part").alias("column", "v")).groupBy("row", "column").agg(F.sum("v").alias("v")).toPandas()
    normal = np.zeros((features + 1, features + 2))
    normal[sums["row"], sums["column"]] = sums["v"]
    penalty = ridge * np.eye(features + 1)
    penalty[0, 0] = 0
    weights = np.linalg.solve(normal[:, :-1] + penalty, normal[:, -1])
    model = QualityModel(blank.centre, blank.scale, blank.projection, blank.phase, weights, blank.knots, blank.shares)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                place = np.clip((model.raw(_matrix(frame["x"])) + 0.5) * BINS / 2, 0, BINS - 1).astype(int)
                yield pd.DataFrame({"bin": place, "y": frame["y"].astype(float)})

    bins = labelled.filter("calibrate").select("x", "y").mapInPandas(raw, "bin int, y double")
    table = bins.groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").toPandas()
    level = pooled_neighbours((table["good"] / table["n"]).to_numpy(), table["n"].to_numpy(float))
    knots = (table["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
    return QualityModel(blank.centre, blank.scale, blank.projection, blank.phase, weights, knots, level)


def score_quality(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc``, ``tkey``, ``score``; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            scores = np.full(len(x), 0.5)
            if model is not None and len(x):
                scores = model.score(x.values.to_numpy().astype(float).reshape(len(x), -1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores)], names=["doc", "tkey", "score"])

    return stats.select("doc", "tkey", "x").mapInArrow(run, "doc long, tkey long, score double")


def held_out(id_col: str) -> Column:
    """Rows whose label is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> DataFrame:
    """Per row of ``docs``: its id, ``text_key``, ``held_out`` and ``score`` between 0 and 1, the likelihood of label 1.

    Only the text counts for a score. Learned from: labelled rows whose crc32(id as text) mod 3 is not 1; of these, those
    whose crc32 mod 5 is 0 serve for calibration only. Null labels and labels of unknown ids are left out; an id labelled
    twice counts twice. Null texts count as empty, and the empty text has a score like any other. Rows without an id are
    scored and not held out. Without labelled rows all scores are 0.5. Further columns are ignored.
    """
    stats = document_statistics(docs, id_col, text_col)
    code = F.crc32(F.col("doc").cast("string").cast("binary"))
    learn = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).cast("double").alias("y")).filter("y is not null")
    labelled = stored(stats.join(learn, "doc").filter(~held_out("doc")).select("x", "y", (code % 5 == 0).alias("calibrate")), "labelled")
    scored = score_quality(stats, fit_quality(labelled, seed=seed))
    return scored.select(F.col("doc").alias(id_col), F.col("tkey").alias("text_key"), F.coalesce(held_out("doc"), F.lit(False)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``; all columns as they are."""
    return without(docs, quality_scores(docs, labels, id_col, text_col).filter(F.col("score") < least), id_col, text_col)
