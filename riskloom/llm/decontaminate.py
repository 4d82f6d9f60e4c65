"""Benchmark decontamination as a prefix-filtered join of word shingles.

Every item gives windows of ``window`` consecutive words (an item of fewer words is one window). A document that holds a
window holds all shingles of it, so one shingle is enough to find it: the window's rarest in the documents. Documents
are joined on those shingles alone; the shingle's place in the window fixes the only possible start, which must lie
inside the document, and the words themselves are compared last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import NOT_ALPHANUMERIC, ascii_lower, text_key, words_between
from riskloom.operators.once import compute_once
from riskloom.session import cut_lineage

#: Rows of a join side (about 300 bytes each) up to which it is sent to every executor; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def item_windows(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item``, ``win`` (its words) of every window, once per item; items without words have none."""
    words = compute_once(
        items.select(F.col(id_col).alias("item"), F.col(text_col).alias("_t")),
        ["item"],
        words_between(ascii_lower(F.col("_t")), NOT_ALPHANUMERIC),
        "words",
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("win")).distinct()


def _hash(words: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, start + i) for i in range(size)))


def _shingles(docs: DataFrame, keep: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """``pos`` and ``key`` of every shingle of ``words``; one more row per document at ``pos`` = number of words."""
    spread = docs.select(*keep, "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "_w"))
    n = F.size("words")
    hashes = [F.when((F.col("pos") + s <= n) | (F.col("pos") == n), _hash(F.col("words"), F.col("pos"), s)) for s in sizes]
    if len(hashes) == 1:
        return spread.withColumn("key", hashes[0]).drop("_w").filter(F.col("key").isNotNull())
    return spread.withColumn("key", F.explode(F.array_compact(F.array(*hashes)))).drop("_w")


def _sized(side: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    small = side.count() <= limit
    return (F.broadcast(side) if small else side), small


def window_hits(
    docs: DataFrame,
    windows: DataFrame,
    shingle: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each document (``doc``, ``key``, ``n_words``) with each place where a window occurs: ``win``, ``start``.

    Every document also has one row with neither. Rows that repeat an id and a text count as one document.
    """
    texts = compute_once(
        docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("_t")),
        ["doc", "tkey"],
        words_between(ascii_lower(F.col("_t")), NOT_ALPHANUMERIC),
        "words",
    )
    distinct = windows.select("win").distinct().withColumn("size", F.least(F.size("win"), F.lit(shingle)))
    sizes = sorted(r[0] for r in distinct.select("size").distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        return texts.select(
            "doc", "tkey", F.size("words").alias("n_words"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("int").alias("start")
        ).distinct()
    by_size = F.coalesce(*(F.when(F.col("size") == s, _hash(F.col("win"), F.col("offset"), s)) for s in sizes))
    parts = cut_lineage(
        distinct.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("size")))).withColumn("part", by_size)
    )
    wanted, _ = _sized(parts.select(F.col("part").alias("key")).distinct(), broadcast_rows)
    counts = _shingles(texts, [], sizes).select("key").join(wanted, "key").groupBy("key").agg(F.count("*").alias("seen"))
    rarest = (
        parts.join(counts, F.col("part") == F.col("key"), "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "part", "offset")).alias("best"))
        .filter(F.col("best.seen") > 0)
        .select("win", F.col("best.part").alias("part"), F.col("best.offset").alias("offset"))
    )
    prefixes = cut_lineage(rarest)
    found, small = _sized(prefixes, broadcast_rows)
    end = F.col("pos") == F.col("n_words")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.slice("words", start + 1, F.size("win")) == F.col("win")
    if small:
        joined = _shingles(texts, ["doc", "tkey"], sizes).withColumn("n_words", F.size("words"))
        hits = joined.join(found, F.col("key") == F.col("part"), "left").filter(end | (inside & same))
        hits = hits.select("doc", "tkey", "n_words", F.when(~end, F.col("win")).alias("win"), F.when(~end, start).alias("start"))
    else:
        lean = _shingles(texts, ["doc", "tkey"], sizes).withColumn("n_words", F.size("words")).drop("words")
        places = lean.join(found, F.col("key") == F.col("part")).filter(inside & ~end)
        places = places.select("doc", "tkey", "win", start.alias("start")).withColumnsRenamed({"doc": "_doc", "tkey": "_tkey"})
        checked = texts.join(places, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")))
        checked = checked.filter(F.slice("words", F.col("start") + 1, F.size("win")) == F.col("win"))
        none = [F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("int").alias("start")]
        hits = checked.select("doc", "tkey", F.size("words").alias("n_words"), "win", "start").unionByName(
            texts.select("doc", "tkey", F.size("words").alias("n_words"), *none)
        )
    return hits.distinct()


def _covered(spans: Column) -> Column:
    """Number of words inside any of the spans, sorted by start."""
    grown = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
    )
    return grown["n"]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document: its id, ``text_key``, ``n_words``, ``n_hit``, ``spans`` (start, end of each occurrence), ``items``.

    Words are runs of ASCII letters and digits (A-Z lowered) and of characters beyond ASCII. Null and empty texts have
    no words and no hits, items without words no windows; an empty benchmark leaves every document clean. Rows that
    repeat an id and a text give one row; an id with several texts has one row for each. Further columns are ignored.
    """
    windows = cut_lineage(item_windows(items, window, item_col, item_text_col))
    hits = cut_lineage(window_hits(docs, windows, shingle, id_col, text_col, broadcast_rows))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.size("win")).cast("long").alias("end"))
    per_doc = hits.groupBy("doc", "tkey", "n_words").agg(F.array_sort(F.collect_set(F.when(F.col("win").isNotNull(), span))).alias("spans"))
    named = (
        hits.filter("win is not null").select("doc", "tkey", "win").distinct().join(windows, "win")
        .select(F.col("doc").alias("_doc"), F.col("tkey").alias("_tkey"), F.col("item").cast("string").alias("item"))
        .groupBy("_doc", "_tkey").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return per_doc.join(named, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")), "left").select(
        F.col("doc").alias(id_col),
        F.col("tkey").alias("text_key"),
        F.col("n_words").cast("long").alias("n_words"),
        _covered(F.col("spans")).alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
