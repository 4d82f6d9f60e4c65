"""Byte pair encoding and decoding.

A batch of texts is reduced to its distinct words, which are encoded together. A short word is one row of two contiguous
arrays: the ids of its parts and the ranks of adjacent parts. Over and over, each row's smallest rank (the leftmost of
equal ones) is found, the boundary between those two parts is deleted, and the ranks on both sides are refreshed, until
no adjacent parts can be merged. Rows of equal length go through this in step. Scanning costs the square of the length,
so longer words keep their ranks in a heap, with the same result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.ragged import as_lists, chosen, joined, places, starts_of, text_slices

#: Symbols of the longest word that is scanned.
SHORT = 48
#: Texts are encoded in groups of about so many bytes, tokens decoded in groups of about so many.
GROUP_BYTES = 2 << 20
GROUP_TOKENS = 1 << 20
#: The rank of parts that can't be merged.
NEVER = np.int32(2**31 - 1)

# The split rule of byte-level tokenizers, and the normalisers this module carries out itself.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_NORMALISERS = [None, ["NFC", "Replace", "Lowercase"]]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def _unassigned() -> regex.Pattern:
    """Code points that Python's tables don't know, whose class a tokenizer with newer tables may know."""
    none = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    first = [c for i, c in enumerate(none) if i == 0 or none[i - 1] != c - 1]
    last = [c for i, c in enumerate(none) if i + 1 == len(none) or none[i + 1] != c + 1]
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last)) + "]")


class Vocabulary:
    """A tokenizer file read into rank arrays.

    Two kinds of files are known: words in lower case with an end-of-word suffix, where white space is dropped, and
    byte-level ones, where it is kept. Anything else in the file is refused rather than encoded wrongly.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, model = path, spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._read_rules(spec)
        names: dict[str, int] = model["vocab"]
        self.tokens = ["" for _ in range(max([*names.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)]
        for name, number in names.items():
            self.tokens[number] = name
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, number in self.specials.items():
            self.tokens[number] = name
        known = byte_characters()
        self.symbols = np.array([names[c] for c in known], np.int32)
        self.last_symbols = np.array([names[c + self.suffix] for c in known], np.int32)
        self._read_merges(model["merges"], names)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _read_rules(self, spec: dict) -> None:
        model, normaliser, splitter = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        steps = normaliser and [n["type"] for n in normaliser.get("normalizers", [normaliser])]
        parts = splitter.get("pretokenizers", [splitter])
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or not plain or steps not in KNOWN_NORMALISERS or parts[-1]["type"] != "ByteLevel" or parts[-1]["add_prefix_space"]:
            raise ValueError(f"{self.path}: not a kind of tokenizer that is known here")
        self.lowers, self.decoder = bool(steps), (spec["decoder"] or {}).get("type")
        if len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]:
            pattern = parts[0]["pattern"]["Regex"]
        elif len(parts) == 1 and parts[0]["use_regex"]:
            pattern = BYTE_LEVEL_SPLIT
        else:
            raise ValueError(f"{self.path}: its split rule is not known here")
        self.split = regex.compile(pattern)
        self.drops_space = not self.split.search("a b\n\t c ", pos=1, endpos=2)
        if self.drops_space != self.lowers or self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"{self.path}: its rules don't go together in a way known here")

    def _read_merges(self, merges: list, names: dict[str, int]) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([names[a] for a, _ in pairs], np.int64)
        right = np.array([names[b] for _, b in pairs], np.int64)
        self.merged = np.array([names[a + b] for a, b in pairs], np.int32)
        self.width = len(self.tokens)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.rank_of = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(left, right))}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging each pair of parts; ``NEVER`` where there is no such merge."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NEVER)

    # -- words to ids

    def pieces(self, words: list[str], specials: bool) -> list[list[str]]:
        """What each word falls into before it is encoded; with ``specials``, strings of special tokens stay whole."""
        whole = "\n".join(words)
        marked = specials and self.special is not None and self.special.search(whole)
        newer = not whole.isascii() and max(whole) > "ͷ" and _unassigned().search(whole)
        if not (marked or newer):
            if self.lowers:
                words = self._normal(whole).split("\n")
            return list(map(self.split.findall, words))
        return [self._pieces_of(word, specials) for word in words]

    def _normal(self, text: str) -> str:
        """NFC, then each character by itself in lower case; white space, which no piece of such a tokenizer holds, is left."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _pieces_of(self, word: str, specials: bool) -> list[str]:
        out: list[str] = []
        for i, part in enumerate(self.special.split(word) if specials and self.special is not None else [word]):
            if i % 2:
                out.append(part)
            elif not part.isascii() and _unassigned().search(part):
                rules = _library(self.path)
                text = rules.normalizer.normalize_str(part) if rules.normalizer else part
                out += [text[a:b] for _, (a, b) in rules.pre_tokenizer.pre_tokenize_str(text)]
            else:
                out += self.split.findall(self._normal(part) if self.lowers else part)
        return out

    def encode_words(self, words: list[str], specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the offsets of each word's ids."""
        found = self.pieces(words, specials)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = pa.array([p for own in found for p in own], pa.string()).dictionary_encode()
        ids, offsets = self._encode_pieces(flat.dictionary, specials)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        own, ends = chosen(ids, offsets, codes)
        return own, ends[starts_of(counts)]

    def _encode_pieces(self, pieces: pa.StringArray, specials: bool) -> tuple[np.ndarray, np.ndarray]:
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        ids = self.symbols[data]
        ids[offsets[1:] - 1] = self.last_symbols[data[offsets[1:] - 1]]
        size = np.ones(len(pieces), np.int64)
        for length in np.unique(lengths[lengths <= SHORT]):
            if length > 1:
                self._merge_rows(ids, starts, size, np.flatnonzero(lengths == length), int(length))
        for i in np.flatnonzero(lengths > SHORT):
            own = self._merge_long(ids[starts[i] : offsets[i + 1]].tolist())
            ids[starts[i] : starts[i] + len(own)], size[i] = own, len(own)
        if specials:
            for name, number in self.specials.items():
                i = pc.index(pieces, name).as_py()
                if i >= 0:
                    ids[starts[i]], size[i] = number, 1
        at, out = places(starts, size)
        return ids[at], out

    def _merge_rows(self, ids: np.ndarray, starts: np.ndarray, size: np.ndarray, rows: np.ndarray, length: int) -> None:
        """Merge the words ``rows``, all of ``length`` symbols, in place; ``size`` gets what is left of each."""
        parts = ids[starts[rows][:, None] + np.arange(length)]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            place = ranks.argmin(1) if parts.shape[1] > 1 else np.zeros(len(rows), np.int64)
            best = ranks[each, place] if parts.shape[1] > 1 else np.full(len(rows), NEVER)
            done = best == NEVER
            if done.any():
                own = parts[done]
                ids[starts[rows[done]][:, None] + np.arange(own.shape[1])] = own
                size[rows[done]] = own.shape[1]
                rows, parts, ranks, place, best = (x[~done] for x in (rows, parts, ranks, place, best))
                if not len(rows):
                    return
                each = np.arange(len(rows))
            parts[each, place] = self.merged[best]
            stays = np.ones(parts.shape, bool)
            stays[each, place + 1] = False
            parts = parts[stays].reshape(len(rows), -1)
            ranks = ranks[stays[:, 1:]].reshape(len(rows), -1)  # the rank left of the deleted boundary goes with it
            width = parts.shape[1]
            for left in (place - 1, place):
                near = (left >= 0) & (left < width - 1)
                i, j = each[near], left[near]
                ranks[i, j] = self.ranks(parts[i, j], parts[i, j + 1])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for one long word, with the ranks in a heap and the parts in a linked list."""
        after, before, rank_of, merged = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), self.rank_of, self.merged.tolist()
        end, gone = len(parts), [False] * len(parts)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(end - 1) if (r := rank_of.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j == end or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = merged[rank], True, after[j]
            if after[j] < end:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < end and (r := rank_of.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, g in zip(parts, gone) if not g]

    # -- ids to text

    def token_bytes(self) -> list[bytes]:
        """What each id stands for; a special token for its own string."""
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = set(self.specials.values())
        return [t.encode() if i in special or not all(c in byte for c in t) else bytes(byte[c] for c in t) for i, t in enumerate(self.tokens)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids; ids that are not in the vocabulary are left out."""
        known = (ids >= 0) & (ids < self.width)
        if not known.all():
            offsets = starts_of(known)[offsets]
            ids = ids[known]
        if self.decoder is None:
            return joined(self._strings, ids, offsets, " ")
        found = pc.binary_join(as_lists(self._bytes.take(pa.array(ids)), offsets), b"")
        return pa.array([b.decode(errors="replace") for b in found.to_pylist()], pa.string())

    @property
    def _strings(self) -> pa.Array:
        if not hasattr(self, "_string_array"):
            self._string_array = pa.array(self.tokens, pa.string())
        return self._string_array

    @property
    def _bytes(self) -> pa.Array:
        if not hasattr(self, "_bytes_array"):
            self._bytes_array = pa.array(self.token_bytes(), pa.binary())
        return self._bytes_array


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _library(path: str):
    """The tokenizer's own normaliser and split rule, for characters newer than Python's tables."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_before_spaces(texts: pa.Array, lead: str = "") -> tuple[pa.DictionaryArray, np.ndarray]:
    """Chunks of all texts, each after ``lead``, as a dictionary array, and the offsets of each text's chunks.

    A chunk begins at the start of a text and at each blank that stands between a character that is no white space and
    anything else. Byte-level tokenizers never join characters across such a place, and a lone blank at the end stays with
    what precedes it. Chunks of a text add up to it.
    """
    whole = texts.cast(pa.large_string())
    if lead:
        whole = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), whole, pa.scalar("", pa.large_string()))
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    buffer = whole.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer else np.zeros(0, np.uint8)
    edges = ends - ends[0]
    first = np.zeros(len(data) + 1, bool)
    first[edges[:-1]] = True
    blanks = np.flatnonzero(data == 0x20)
    blanks = blanks[blanks > 0]
    blanks = blanks[~first[blanks]]
    if len(blanks):
        back = [data[np.maximum(blanks - i, 0)].astype(np.int32) for i in (1, 2, 3)]
        two, three = back[1] << 8 | back[0], back[2] << 16 | back[1] << 8 | back[0]
        space = (back[0] <= 0x20) | (two == 0xC285) | (two == 0xC2A0)
        space |= (three == 0xE19A80) | (three >= 0xE28080) & (three <= 0xE2808A) | (three == 0xE280A8) | (three == 0xE280A9) | (three == 0xE280AF) | (three == 0xE2819F) | (three == 0xE38080)
        last = np.zeros(len(data) + 1, bool)
        last[edges[1:]] = True
        blanks = blanks[~space & ~last[blanks + 1]]
    first[blanks] = True
    begins = np.flatnonzero(first[:-1])
    offsets = np.concatenate([begins, [len(data)]]).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks.dictionary_encode(), np.searchsorted(begins, edges)


def encode_batch(vocab: Vocabulary, texts: pa.Array, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of whole texts and the offsets of each text's ids; each distinct word of the batch is encoded once."""
    texts = texts.fill_null("")
    if vocab.drops_space:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words, ends = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode(), offsets - offsets[0]
    elif specials and vocab.special is not None:  # a special token's string may hold a blank
        words, ends = texts.dictionary_encode(), np.arange(len(texts) + 1)
    else:
        words, ends = split_before_spaces(texts)
    ids, own = vocab.encode_words(words.dictionary.to_pylist(), specials)
    flat, out = chosen(ids, own, words.indices.to_numpy(zero_copy_only=False))
    return flat, out[ends]


def _encoding(path: str, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), GROUP_BYTES):
                ids, offsets = encode_batch(vocab, texts, specials)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), as_lists(ids, offsets, pa.int32())], names=["_row", "ids"])

    return run


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), specials: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``, the token ids of each whole text; a row for each row.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Null and empty texts have no ids. Strings of
    special tokens inside a text become those tokens, or with ``specials=False`` plain text. A column ``ids`` among
    ``keep`` gives way; others may have any name. Rows, repeated ones too, are encoded by themselves.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep if c != "ids")).alias("_row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoding(tokenizer, specials), schema).select("_row.*", "ids")


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids, at = batch.column(1), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_TOKENS, "right")))
                part = ids.slice(at, to - at)
                counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False)
                texts = vocab.decode(flat, starts_of(counts))
                yield pa.record_batch([batch.column(0).slice(at, to - at), pc.if_else(part.is_null(), None, texts)], names=["_row", "decoded"])
                at = to

    return run


def decode_ids(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``tokens`` and ``decoded``, the text of each list of ids, special tokens included.

    No ids give the empty string, a null list gives null; null ids and ids that the tokenizer doesn't have are left out.
    Bytes that are no UTF-8 become U+FFFD. A column ``decoded`` among ``keep`` gives way.
    """
    rows = tokens.select(
        F.struct(*(F.col(f"`{c}`") for c in keep if c != "decoded")).alias("_row"), F.col(ids_col).cast("array<int>").alias("ids")
    )
    schema = T.StructType([rows.schema["_row"], T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoding(tokenizer), schema).select("_row.*", "decoded")
