"""URL filter: host and path rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

The trees are trained from labelled URLs. Features are columns of SQL functions; training and scoring run in the JVM.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

#: Labelled URLs that a model is fitted on at most; of more, a share is taken by the hash of the URL.
TRAIN_ROWS = 20_000
#: Statistics of host suffixes are kept for so many hash buckets, which bounds the table that is broadcast.
SUFFIX_BUCKETS = 1024
FEATURES = (
    "url_length", "host_length", "host_labels", "host_hyphens", "path_length", "depth", "digit_ratio", "upper_ratio",
    "entropy", "parameters", "has_fragment", "has_extension", "suffix_count", "suffix_length",
)


@dataclass(frozen=True)
class Rule:
    """What happens to URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to a slash, question mark or hash sign, A-Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash sign; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text and verdict of the longest rule that fits; null if none does."""
    cases = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if cases is None else cases


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, "")).cast("double")


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the columns ``FEATURES``; statistics of suffixes are taken over all rows."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(
        F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda total, n: total - (n / size) * F.log2(n / size)
    )
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    bucket = F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")
    rows = urls.withColumn("_bucket", bucket)
    suffixes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), F.avg(F.length(url)).alias("suffix_length"))
    return rows.join(F.broadcast(suffixes), "_bucket").withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_labels": _count(F.col("host"), r"[^.]"),
            "host_hyphens": _count(F.col("host"), r"[^-]"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
            "digit_ratio": _count(url, r"[^0-9]") / size,
            "upper_ratio": _count(url, r"[^A-Z]") / size,
            "entropy": entropy,
            "parameters": F.size(F.array_remove(F.split(query, "[&;]"), "")).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "has_extension": F.coalesce(F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), F.lit(False)).cast("double"),
            "suffix_count": F.log(F.col("_n").cast("double")),
        }
    ).drop("_bucket", "_n")


def fit_filter(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4, seed: int = 7) -> GBTClassificationModel | str | None:
    """A model of rows (url, verdict, ``FEATURES``); the verdict itself if all have one, None without rows."""
    seen = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return next(iter(seen), None)
    share = min(1.0, train_rows / sum(seen.values()))
    drawn = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(drawn)
    rows = cut_lineage(rows.select("x", (F.col("verdict") == "block").cast("double").alias("y")).repartition(8))
    if rows.select("y").distinct().count() < 2:
        return max(seen, key=lambda v: (seen[v], v))
    return GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed).fit(rows)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labelled: DataFrame | None = None,
    url_col: str = "url",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (and ``by_rule``) added or replaced.

    The longest fitting rule decides; otherwise trees learned from ``labelled`` (url, verdict: block or allow), or,
    without such a table, from the URLs that a rule fits. Null URLs and those without ``://`` have empty host and path
    and are judged by the trees like others. With labels of one kind only, that kind is the verdict; without any,
    URLs are allowed. Every row gives one row; the same URL always has the same verdict.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "by_rule")]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    named = pages.select(row, F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = named.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    plain = ruled.select("url", "host", "path", F.col("fit.verdict").alias("verdict"))
    if labelled is None:
        learn = lexical_features(plain).filter("verdict is not null")
    else:
        told = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
        learn = lexical_features(told).filter("verdict is not null")
    model = fit_filter(learn, train_rows)
    if model is None or isinstance(model, str):
        guess, rows = F.lit(model or "allow"), ruled
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(lexical_features(ruled))
        rows = model.setFeaturesCol("x").setPredictionCol("p").setRawPredictionCol("").setProbabilityCol("").transform(rows)
        guess = F.when(F.col("p") == 1, "block").otherwise("allow")
    return rows.select(
        *(F.col("row")[c].alias(c) for c in keep), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", guess).alias("verdict"), F.col("fit").isNotNull().alias("by_rule"),
    )
