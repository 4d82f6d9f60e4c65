"""Documents to packed training sequences: each stage works on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``. Its result is written as Parquet in the shared folder and read again as the
documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontaminate import contamination
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.near_dedup import drop_near_duplicates
from riskloom.llm.packing import pack_pieces, token_pieces
from riskloom.llm.quality import keep_good
from riskloom.llm.columns import without
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score below one half."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines of any length that repeat an earlier line, and those that nearly repeat one.

    ``n_chars`` follows the text. A document that loses all its words is dropped; one that had none stays.
    """
    out = dedup_lines(docs, every_line=True)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words, or all words, of a benchmark item."""
    found = contamination(docs, _table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    return without(docs, found, "doc_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; one row for each piece."""
    pieces = token_pieces(docs, tokenizer_path())
    return pack_pieces(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: Learned scores and best fit are beyond SQL; ``tests/llm/test_pipeline.py`` compares every stage and ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
