"""Removal of word windows that an earlier document holds, by super-k-mer partitioning.

The smallest hash among the runs of ``seed`` words inside a window is its minimiser: equal windows have equal
minimisers. Consecutive windows with one minimiser form one super-k-mer, which travels as one string to the bucket of
the minimiser; there the windows are cut out and sorted, and equal neighbours show which document holds one first.

What need not travel stays: super-k-mers whose minimiser is in no other document can't hold a shared window; of equal
super-k-mers one is sent; and a bucket of nothing but equal ones needs no sorting. A bucket with more different strings
than ``bucket_strings`` (a passage met in very many surroundings) is dealt out again by window: its windows are hashed to
128 bits and grouped by that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import text_key
from riskloom.llm.storage import stored
from riskloom.llm.wordhash import leftmost_minimum, run_hashes, span_hashes, word_groups

SEED = 8
#: Different strings of a bucket that one task sorts at most (some 130 MB); beyond, the bucket is dealt out by window.
BUCKET_STRINGS = 10_000


def _super_kmers(width: int, seed: int):
    """Rows (minimiser, content, doc, tkey, first window, number of windows) of Arrow batches (doc, tkey, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, to, words in word_groups(batch.column(2)):
                runs = run_hashes(words.hash, seed)
                places = leftmost_minimum(runs, width - seed + 1)
                of = np.repeat(np.arange(to - at), np.diff(words.first))[: len(places)]
                start = np.arange(len(places))
                valid = start + width <= words.first[of + 1]
                start, of, places = start[valid], of[valid], places[valid]
                if not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (places[1:] != places[:-1]) | (of[1:] != of[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(start)))
                content = span_hashes(words.hash, start[head], start[head] + count + width - 1)
                which = at + of[head]
                columns = (
                    runs[places[head]].view(np.int64), content.view(np.int64), docs[which], keys[which],
                    (start[head] - words.first[of[head]]).astype(np.int32), count.astype(np.int32),
                )
                yield pa.record_batch([pa.array(c) for c in columns], names=["minimiser", "content", "doc", "tkey", "start", "n"])

    return run


def _pack(width: int):
    """Strings of the wanted super-k-mers: rows (minimiser, content, first, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for at, to, words in word_groups(batch.column(1)):
                text, out = words.data.tobytes(), ([], [], [], [])
                for i in range(at, to):
                    first, last, doc = int(words.first[i - at]), int(words.first[i - at + 1]), batch.column(0)[i].as_py()
                    own = text[words.start[first] : words.end[last - 1]].split()
                    for w in batch.column(2)[i].as_py():
                        packed = b" ".join(own[w["start"] : w["start"] + w["n"] + width - 1]).decode()
                        for column, value in zip(out, (w["minimiser"], w["content"], doc, packed)):
                            column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names=["minimiser", "content", "first", "packed"])

    return run


def _windows(packed: str, width: int) -> list[str]:
    words = packed.split(" ")
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _bucket(rows: list[tuple[int, int, int, str]], width: int) -> list[tuple[int, int, list[int]]]:
    """For each string of a bucket, and each of its windows, the first document that has it; windows are sorted."""
    windows = sorted((w, first, i, k) for i, (_, _, first, packed) in enumerate(rows) for k, w in enumerate(_windows(packed, width)))
    out = [[0] * (packed.count(" ") + 2 - width) for *_, packed in rows]
    window, owner = None, 0
    for w, first, i, k in windows:
        if w != window:
            window, owner = w, first  # the first of equal windows has the smallest id
        out[i][k] = owner
    return [(m, c, own) for (m, c, _, _), own in zip(rows, out)]


def _owners(width: int):
    """Rows (minimiser, content, owners) of rows (minimiser, content, first, packed) sorted by minimiser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = ["minimiser", "content", "owners"], []
        for frame in frames:
            done = []
            for row in frame[["minimiser", "content", "first", "packed"]].itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    done += _bucket(held, width)
                    held = []
                held.append(row)
            yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame(_bucket(held, width), columns=names)

    return run


def _crowded(width: int):
    """Windows of crowded buckets as rows (minimiser, content, k, first, 128-bit hash of the window)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m, c, f, packed in zip(frame["minimiser"], frame["content"], frame["first"], frame["packed"]):
                hashes = [hashlib.blake2b(w.encode(), digest_size=16).digest() for w in _windows(packed, width)]
                yield pd.DataFrame({"minimiser": m, "content": c, "k": range(len(hashes)), "first": f, "window": hashes})

    return run


def _sorted_out(strings: DataFrame, width: int, bucket_strings: int) -> DataFrame:
    """``minimiser``, ``content``, ``owners`` of every string; ``kinds`` tells how many different ones its bucket has."""
    few = strings.filter(F.col("kinds") <= bucket_strings).select("minimiser", "content", "first", "packed")
    plain = few.repartition("minimiser").sortWithinPartitions("minimiser").mapInPandas(_owners(width), "minimiser long, content long, owners array<long>")
    many = strings.filter(F.col("kinds") > bucket_strings).select("minimiser", "content", "first", "packed")
    windows = many.mapInPandas(_crowded(width), "minimiser long, content long, k int, first long, window binary")
    owner = windows.groupBy("window").agg(F.min("first").alias("owner"))
    dealt = windows.join(owner, "window").groupBy("minimiser", "content").agg(F.array_sort(F.collect_list(F.struct("k", "owner"))).alias("o"))
    return plain.unionByName(dealt.select("minimiser", "content", F.col("o.owner").alias("owners")))


def repeated_windows(
    docs: DataFrame,
    width: int = 50,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_strings: int = BUCKET_STRINGS,
) -> DataFrame:
    """``doc``, ``tkey``, ``starts``: word numbers at which a window starts that also starts in a document with a smaller id."""
    if not 1 <= seed <= width:
        raise ValueError("a seed has between one word and a window's")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")).filter("doc is not null")
    schema = "minimiser long, content long, doc long, tkey long, start int, n int"
    mers = stored(texts.mapInArrow(_super_kmers(width, seed), schema), "super-k-mers")
    shared = mers.groupBy("minimiser").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).filter("_a < _b").select("minimiser")
    mers = stored(mers.join(shared, "minimiser"), "shared-super-k-mers")
    firsts = mers.groupBy("minimiser", "content").agg(F.min("doc").alias("first"))
    kinds = firsts.groupBy("minimiser").agg(F.count("*").alias("kinds"))
    firsts = stored(firsts.join(kinds, "minimiser"), "different-super-k-mers")

    several = firsts.filter("kinds > 1").select("minimiser", "content", F.col("first").alias("doc"), "kinds")
    chosen = mers.join(several.drop("kinds"), ["minimiser", "content", "doc"]).groupBy("minimiser", "content", "doc").agg(F.min(F.struct("tkey", "start", "n")).alias("s"))
    wanted = chosen.groupBy("doc", F.col("s.tkey").alias("tkey")).agg(F.collect_list(F.struct("minimiser", "content", "s.start", "s.n")).alias("wanted"))
    sent = texts.join(wanted.hint("shuffle_hash"), ["doc", "tkey"]).select("doc", "text", "wanted")
    packed = sent.mapInArrow(_pack(width), "minimiser long, content long, first long, packed string")
    strings = stored(packed.join(several.select("minimiser", "content", "kinds"), ["minimiser", "content"]), "super-k-mer-strings")
    sorted_out = stored(_sorted_out(strings, width, bucket_strings), "window-owners")

    alone = firsts.filter("kinds = 1").select("minimiser", "content", F.col("first").alias("_first"), F.lit(None).cast("array<long>").alias("owners"))
    owned = alone.unionByName(sorted_out.withColumn("_first", F.lit(None).cast("long")))
    later = F.when(
        F.col("owners").isNull(), F.when(F.col("_first") < F.col("doc"), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    ).otherwise(F.array_compact(F.transform("owners", lambda o, k: F.when(o < F.col("doc"), F.col("start") + k))))
    flagged = mers.join(owned, ["minimiser", "content"]).select("doc", "tkey", later.alias("starts")).filter(F.size("starts") > 0)
    return stored(flagged.groupBy("doc", "tkey").agg(F.flatten(F.collect_set("starts")).alias("starts")), "repeated-windows")


def _cut(width: int):
    """Rows (doc, n_words, n_removed, kept) of Arrow batches (doc, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for at, to, words in word_groups(batch.column(1)):
                text = words.data.tobytes()
                for i in range(at, to):
                    first, last = int(words.first[i - at]), int(words.first[i - at + 1])
                    own = text[words.start[first] : words.end[last - 1]].split() if last > first else []
                    starts = batch.column(2)[i].as_py()
                    counts.append(len(own))
                    if starts:
                        edge = np.zeros(len(own) + 1, np.int64)
                        begin = np.unique(np.asarray(starts))
                        edge[begin] += 1
                        edge[begin + width] -= 1
                        gone = np.cumsum(edge[:-1]) > 0
                        own = [w for w, g in zip(own, gone.tolist()) if not g]
                    removed.append(counts[-1] - len(own))
                    kept.append(b" ".join(own).decode())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated_windows(
    docs: DataFrame,
    width: int = 50,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_strings: int = BUCKET_STRINGS,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept``, the words that no repeated window covers.

    Words are separated by ASCII white space and compared as they are; ``kept`` has them joined by one space. A window
    of ``width`` words is repeated if its words also start in a document with a smaller id; all windows are judged on
    the input. Null and empty texts have no words, texts of fewer than ``width`` words no windows. Rows that repeat an
    id and a text are judged alike, as are several texts of one id (an id never repeats itself). Rows without an id
    keep all words and cost others none. Further columns are ignored. Ids are whole numbers.
    """
    starts = repeated_windows(docs, width, seed, id_col, text_col, bucket_strings).withColumnsRenamed({"doc": "_d", "tkey": "_k"})
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    joined = rows.join(starts.hint("shuffle_hash"), (F.col("doc") == F.col("_d")) & (F.col("tkey") == F.col("_k")), "left")
    out = joined.select("doc", "text", "starts").mapInArrow(_cut(width), "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", id_col)
