"""Which tokens of one tokenizer cover the same text as which tokens of another.

Texts of a batch are cut at places where both tokenizers always cut, and each distinct piece is tokenised once by either.
For every token start of one side ``merge_asof`` finds the other side's token that covers it, keyed by document (here: by
distinct piece of one); both directions together are all overlaps. Overlaps whose tokens end together are links, and the
common ends cut the tokens into groups. Links are counted over the corpus in Spark, and each document gets its own back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import Vocabulary, split_before_spaces, vocabulary
from riskloom.llm.ragged import as_lists, chosen, joined, starts_of, sums, text_slices
from riskloom.llm.storage import stored

GROUP_BYTES = 2 << 20
#: Id pairs (16 bytes each and their count) up to which the counts are broadcast; beyond, they are joined by shuffle.
BROADCAST_PAIRS = 500_000

ALIGNED = "doc long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:long,n:int>>"


class Pieces:
    """A sentencepiece model whose pieces hold blanks in front only, so that what follows a blank stands by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        if any("▁" in n.lstrip("▁") for n in names) or self.model.encode("  a", out_type=str) == self.model.encode("a", out_type=str):
            raise ValueError(f"{path}: its pieces reach across blanks, or it drops blanks")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of chunks that each begin with a blank, which is the one the model puts in front."""
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), np.int32, int(counts.sum())), starts_of(counts)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _byte_lengths(vocab: Vocabulary) -> tuple[np.ndarray, pa.Array]:
    own = vocab.token_bytes()
    return np.array([len(b) for b in own]), pa.array(own, pa.binary())


def covering(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """All pairs of overlapping tokens, as ``left`` and ``right`` row numbers, ``end_left`` and ``end_right``.

    Both sides have ``doc``, ``start`` and ``end``, rise by them, and cover their document without gaps; starts count on
    from one document to the next. A pair overlaps if the later of the two starts lies in the other token.
    """
    a = left.assign(left=np.arange(len(left))).rename(columns={"end": "end_left"})
    b = right.assign(right=np.arange(len(right))).rename(columns={"end": "end_right"})
    columns = ["left", "right", "end_left", "end_right"]
    into_right = pd.merge_asof(a, b, on="start", by="doc")[columns]
    at = np.searchsorted(a["start"].to_numpy(), b["start"].to_numpy())
    shared = np.append(a["start"].to_numpy(), -1)[at] == b["start"].to_numpy()  # such pairs were found from the left
    into_left = pd.merge_asof(b[~shared], a, on="start", by="doc")[columns]
    both = pd.concat([into_right, into_left], ignore_index=True)
    return both.sort_values("left", kind="stable", ignore_index=True)


def _tokens(ids: np.ndarray, offsets: np.ndarray, length_of: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(length_of[ids])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), "start": ends - length_of[ids], "end": ends})


def _group_texts(ids: np.ndarray, tokens: pd.DataFrame, common: np.ndarray) -> pa.Array:
    """The ids of each group, comma-joined; ``common`` are the ends of the groups."""
    edges = np.concatenate([[0], np.searchsorted(tokens["end"].to_numpy(), common) + 1])
    return pc.binary_join(as_lists(pa.array(ids).cast(pa.string()), edges), ",")


class Aligned:
    """The distinct chunks of a batch, aligned: counts, groups and links of each."""

    def __init__(self, a: Vocabulary, b: Pieces, chunks: list[str]):
        raw = [c.encode() for c in chunks]
        ids_a, at_a = a.encode_words(chunks, specials=False)
        ids_b, at_b = b.encode(chunks)
        length_a, bytes_a = _byte_lengths(a)
        length_b, bytes_b = np.array([len(x) for x in b.bytes]), pa.array(b.bytes, pa.binary())
        self.same = np.ones(len(chunks), bool)
        for names, ids, offsets in ((bytes_a, ids_a, at_a), (bytes_b, ids_b, at_b)):
            text = pc.binary_join(as_lists(names.take(pa.array(ids)), offsets), b"")
            self.same &= np.asarray(pc.equal(text, pa.array(raw, pa.binary())))
        keep = np.flatnonzero(self.same)  # a chunk that is not the same leaves its whole document without tokens
        self.n_a, self.n_b = np.diff(at_a), np.diff(at_b)
        ids_a, at_a = chosen(ids_a, at_a, keep)
        ids_b, at_b = chosen(ids_b, at_b, keep)
        left, right = _tokens(ids_a, at_a, length_a), _tokens(ids_b, at_b, length_b)
        pairs = covering(left, right)
        links = pairs[pairs["end_left"] == pairs["end_right"]]
        common = links["end_left"].to_numpy()  # tokens have at least one byte, so each common end is one link
        texts = pc.binary_join_element_wise(_group_texts(ids_a, left, common), _group_texts(ids_b, right, common), "|")
        chunk_ends = left["end"].to_numpy()[at_a[1:] - 1] if len(keep) else np.zeros(0, np.int64)
        group_ends = np.concatenate([[0], np.searchsorted(common, chunk_ends, "right")]).astype(np.int64)
        place = np.searchsorted(keep, np.arange(len(chunks)))
        per_chunk = lambda ends: starts_of(np.where(self.same, np.diff(ends)[np.minimum(place, len(keep) - 1)] if len(keep) else 0, 0))
        self.group_offsets = per_chunk(group_ends)
        own = links["left"].to_numpy()
        self.links = ids_a[own].astype(np.int64) << 32 | ids_b[links["right"].to_numpy()]
        self.link_offsets = per_chunk(np.searchsorted(left["doc"].to_numpy()[own], np.arange(len(keep) + 1)))
        self.texts = pc.binary_join(as_lists(texts, self.group_offsets), ";")

    def of(self, codes: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        """The columns of ``ALIGNED`` after the first, for texts made of the chunks ``codes[offsets[i]:offsets[i + 1]]``."""
        odd = sums(~self.same[codes], offsets) > 0
        codes = codes[np.repeat(~odd, np.diff(offsets))]
        offsets = starts_of(np.where(odd, 0, np.diff(offsets)))
        numbers = [sums(n[codes], offsets) for n in (self.n_a, self.n_b, np.diff(self.group_offsets), np.diff(self.link_offsets))]
        links, ends = chosen(self.links, self.link_offsets, codes)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[offsets]))
        order = np.lexsort((links, doc))
        links, doc = links[order], doc[order]
        new = np.ones(len(links), bool)
        new[1:] = (links[1:] != links[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(links))).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(links[first]), pa.array(counts)], ["pair", "n"])
        per_doc = as_lists(rows, np.searchsorted(doc[first], np.arange(len(offsets))))
        return [*map(pa.array, numbers), joined(self.texts, codes, offsets, ";"), per_doc]


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(path_a), _pieces(path_b)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), GROUP_BYTES):
                filled = texts.fill_null("")
                chunks, offsets = split_before_spaces(filled, lead=" ")
                empty = np.asarray(pc.equal(filled, ""))
                codes = chunks.indices.to_numpy(zero_copy_only=False)
                codes = codes[np.repeat(~empty, np.diff(offsets))]
                offsets = starts_of(np.where(empty, 0, np.diff(offsets)))
                columns = Aligned(a, b, chunks.dictionary.to_pylist()).of(codes, offsets)
                names = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *columns], names=names)

    return run


def align_texts(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text under both tokenizers: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``links``.

    ``byte_bpe`` (a byte-level tokenizer file) encodes a blank and the text, ``piece_bpe`` (a sentencepiece model) the
    text, before which it puts a blank itself; strings of special tokens are plain text. ``groups`` reads
    ``a1,a2|b1;a3|b2``: ids of both sides between places where tokens of both end. ``links`` holds each pair of ids whose
    tokens end together, as ``a * 2^32 + b``, and how often. Null and empty texts, and texts whose tokens of either side
    don't add up to blank and text, have no tokens: zeros, the empty string, no links. Every row is a document of its own,
    whatever its id. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_align(byte_bpe, piece_bpe), ALIGNED).withColumnRenamed("doc", id_col)


def link_totals(aligned: DataFrame) -> DataFrame:
    """Each id pair's number of links in all documents, and whether that is the highest of its second id (ties included)."""
    totals = stored(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("count")), "links")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    best = totals.groupBy(second).agg(F.max("count").alias("most"))
    return totals.join(best, totals["pair"].bitwiseAND(F.lit(0xFFFFFFFF)) == best["b"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned``, its columns but ``links`` kept, with ``n_best`` and ``count_sum``.

    ``count_sum`` adds up, over a document's links, how many links hold the same pair anywhere; ``n_best`` counts the links
    whose pair is the commonest of its second id. ``aligned`` is stored first. Pairs meet their counts by a broadcast of
    the counts if they are few, else by a shuffle, where Spark splits a pair that very many documents hold; a document's
    sums are added up before they are shuffled.
    """
    rows = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    totals = stored(link_totals(rows), "totals")
    few = totals.count() <= broadcast_pairs
    own = rows.select("_row", F.inline("links"))
    met = own.join(F.broadcast(totals) if few else totals, "pair")
    per_row = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    zero = {"n_best": 0, "count_sum": 0}
    return rows.drop("links").join(per_row, "_row", "left").drop("_row").fillna(zero)
