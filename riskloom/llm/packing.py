"""Packing of documents into training sequences by best fit decreasing.

Documents are tokenised and cut into full windows and a rest. Pieces are dealt at random into groups of about
``group_pieces``, far more than a sequence holds, and each group is packed by itself: longest piece first, each into
the open window whose remaining capacity is the smallest that suffices. A segment tree over the capacities finds it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bpe import GROUP_BYTES, Vocabulary, encode_batch, vocabulary
from riskloom.llm.ragged import starts_of, text_slices
from riskloom.llm.storage import stored

WINDOW = 4096
GROUP_PIECES = 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@lru_cache(maxsize=2)
def _rank_arrays(path: str) -> Vocabulary | None:
    """The tokenizer as rank arrays, which encode each distinct word of a batch once; none for kinds they don't know."""
    try:
        return vocabulary(path)
    except ValueError:
        return None


def _ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of whole texts and the offsets of each text's ids."""
    known = _rank_arrays(path)
    if known is not None:
        return encode_batch(known, texts)
    codes = _tokenizer(path).encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
    return np.fromiter((i for c in codes for i in c.ids), np.int32), starts_of(np.array([len(c.ids) for c in codes], np.int64))


def _pieces(ids: np.ndarray, offsets: np.ndarray, end_id: int, window: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Which text each piece is of, and start, length, ids and number of tokens of its text, with the end token."""
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    whole = np.full(len(ids) + len(ends), end_id, "<u4")
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = ids
    tokens = np.diff(offsets) + 1
    counts = -(-tokens // window)
    text = np.repeat(np.arange(len(tokens)), counts)
    start = (np.arange(len(text)) - np.repeat(starts_of(counts)[:-1], counts)) * window
    length = np.minimum(tokens[text] - start, window)
    places = pa.py_buffer((4 * starts_of(length)).astype(np.int32))
    raw = pa.Array.from_buffers(pa.binary(), len(text), [None, places, pa.py_buffer(whole)])
    return text, [pa.array(start), pa.array(length), raw, pa.array(tokens[text])]


def _cut(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(1), GROUP_BYTES):
                text, columns = _pieces(*_ids(path, texts.fill_null("")), end_id, window)
                docs = batch.column(0).slice(at, len(texts)).take(pa.array(text))
                yield pa.record_batch([docs, *columns], names=["doc", "start", "length", "ids", "doc_tokens"])

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``window`` tokens: id, ``start``, ``length``, ``ids`` (little-endian 32 bits each), ``doc_tokens``.

    ``tokenizer`` is the path of a tokenizer file every worker can read. Each text ends with ``end_id``; null and empty
    texts have it alone. Files of the kinds that ``bpe`` reads are encoded there, with the ids the tokenizers library gives;
    others by that library, text by text. Every row of ``docs`` is a document of its own, whatever its id. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, start long, length long, ids binary, doc_tokens long"
    return rows.mapInArrow(_cut(tokenizer, end_id, window), schema).withColumnRenamed("doc", id_col)


class _OpenWindows:
    """Open windows by remaining capacity; node i of the tree counts those below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, number: int) -> None:
        self.open.setdefault(capacity, []).append(number)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return the tightest window with room for ``length``, as capacity and number."""
        count, node = self.count, length + self.size
        while not count[node]:  # up to the first node to the right that has windows
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while not count[node] and not node & 1:
                node >>= 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; lengths fall and none exceeds the window."""
    windows, numbers, offsets, last = _OpenWindows(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        found = windows.take(length)
        if found is None:
            capacity, number = window, last
            last += 1
        else:
            capacity, number = found
        numbers[i], offsets[i] = number, window - capacity
        if capacity > length:
            windows.add(capacity - length, number)
    return numbers, offsets


def _unused(columns: Sequence[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def pack_pieces(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES, length_col: str = "length") -> DataFrame:
    """``pieces``, all columns kept, with ``sequence_id`` and ``offset``; offsets of a sequence follow one another from 0.

    ``pieces`` is stored first, so that a lost executor can't change what is dealt where. Lengths lie between 1 and
    ``window``. An empty table gives an empty table. Ties in length are taken in the order of storage. Columns named
    ``sequence_id`` or ``offset`` give way to the new ones.
    """
    kept = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    piece, group = _unused(kept.columns, "_piece"), _unused(kept.columns, "_group")
    rows = stored(kept.withColumn(piece, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(length_col, "descending"), (piece, "ascending")])
        numbers, offsets = best_fit(table[length_col].to_numpy(), window)
        numbers = numbers * groups + table[group].to_numpy()
        return table.drop_columns([piece, group]).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    grouped = rows.withColumn(group, F.pmod(F.xxhash64(piece), F.lit(groups)))
    schema = T.StructType([*kept.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return grouped.groupBy(group).applyInArrow(pack, schema)
