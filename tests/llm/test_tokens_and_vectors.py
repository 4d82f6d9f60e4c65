"""Encoding, alignment and whitening against the tokenizers' own libraries and brute force."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskloom.llm import queries
from riskloom.llm.alignment import align_texts, covering, with_link_counts
from riskloom.llm.bpe import Vocabulary, decode_ids, encode_texts
from riskloom.llm.whitening import fit_whitening, whiten

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = (
    ["<|endoftext|>", "<|startoftext|>x", "<|START", "İ", "ΑΣ", "'s", "don't", "Ⅷ", "é", "\x00", "\x1c", " ", "　", "▁"]
    + ["日本語テキスト", "🙂👍🏽", "a" * 300, "x1y2" * 40, "࢏", "\U0001e6c0b", "꟎", "  ", "\t\n", "...!!", "ﬁ", "ß", "ǅ", " ", "\u0085"]
    + ["​", "각", "#" * 100, "12345", "’s", "<s>", "<0x41>", "hello", "World", "the"]
)


def odd_texts(seed, count):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(25))) for _ in range(count)]
    return [*made, "", None, " ", "  ", "a ", "a  ", "a b", "a b"]


def frame(spark, texts, parts=3):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(parts)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("specials", [True, False])
def test_ids_and_texts_are_the_librarys(spark, path, specials):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not specials
    texts = odd_texts(3, 400)
    tokens = encode_texts(frame(spark, texts), path, specials=specials)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in decode_ids(tokens, path, keep=["doc_id", "ids"]).collect()}
    for i, text in enumerate(texts):
        want = own.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (want, own.decode(want, skip_special_tokens=False)), text


def test_words_of_every_length_and_ties():
    vocab, own = Vocabulary(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(5)
    words = ["".join(rng.choice("aet") for _ in range(n)) for n in range(1, 120)] + ["a" * n for n in range(1, 120)]
    ids, ends = vocab.encode_words(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [own.encode(w, add_special_tokens=False).ids for w in words]


def test_a_very_long_word_ends_soon():
    vocab, own = Vocabulary(WORD), Tokenizer.from_file(WORD)
    word = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert vocab.encode_words([word])[0].tolist() == own.encode(word, add_special_tokens=False).ids


def test_decoding_odd_lists(spark):
    rows = [(1, [1, None, 999_999, -4, 2]), (2, []), (3, None), (4, [49407])]
    out = decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), WORD)
    names = Tokenizer.from_file(WORD)
    assert dict(map(tuple, out.collect())) == {1: f"{names.id_to_token(1)} {names.id_to_token(2)}", 2: "", 3: None, 4: "<|endoftext|>"}


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(WORD, encoding="utf-8"))
    spec["normalizer"]["normalizers"].append({"type": "StripAccents"})
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        Vocabulary(str(tmp_path / "t.json"))


def test_encoding_query(spark, tmp_path):
    spark.createDataFrame([(4, "The  cat's <|endoftext|>"), (5, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(WORD)
    want = set()
    for doc, text in ((4, "The  cat's <|endoftext|>"), (5, "")):
        ids = own.encode(text, add_special_tokens=False).ids
        want.add((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = queries.op11_bpe_encoding(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and set(map(tuple, rows)) == want


def test_encoding_of_nothing(spark):
    assert encode_texts(frame(spark, []), WORD).columns == ["doc_id", "ids"]
    assert encode_texts(frame(spark, []), WORD).collect() == []


# -- alignment


class Sides:
    """Tokens of both libraries for one text, with their bytes."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
        self.a.encode_special_tokens = True
        self.bytes_a = Vocabulary(BYTE).token_bytes()

    def of(self, text):
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [self.bytes_a[i] for i in ids_a]
        names = [self.b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        want = (" " + text).encode()
        return (ids_a, raw_a, ids_b, raw_b) if text and b"".join(raw_a) == want == b"".join(raw_b) else ([], [], [], [])


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) by comparing all byte ranges."""
    sides, per_text, counts = Sides(), [], Counter()
    for text in texts:
        ids_a, raw_a, ids_b, raw_b = sides.of(text or "")
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(a, b) for a, e in zip(ids_a, ends_a) for b, f in zip(ids_b, ends_b) if e == f]
        groups, low = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = cut
        per_text.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
        counts.update(links)
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    return [(a, b, g, len(ls), text, sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls)) for a, b, g, ls, text in per_text]


@pytest.mark.parametrize("broadcast_pairs", [0, 10**6])
def test_alignment(spark, broadcast_pairs):
    texts = odd_texts(9, 150)
    out = with_link_counts(align_texts(frame(spark, texts), BYTE, PIECE), broadcast_pairs).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")) for r in out}
    assert got == dict(enumerate(brute_alignment(texts)))


def test_overlaps_are_all_found():
    import pandas as pd

    rng = random.Random(2)
    sides = []
    for _ in range(2):
        rows, at = [], 0
        for doc in range(20):
            stop = 10 * (doc + 1)
            while at < stop:
                end = min(stop, at + rng.randrange(1, 5))
                rows.append((doc, at, end))
                at = end
        sides.append(pd.DataFrame(rows, columns=["doc", "start", "end"]))
    left, right = sides
    got = set(zip(*(covering(left, right)[c] for c in ("left", "right"))))
    rows = lambda side: list(enumerate(zip(side["start"], side["end"])))
    assert got == {(i, j) for i, (s, e) in rows(left) for j, (t, f) in rows(right) if s < f and t < e}


def test_alignment_query(spark, tmp_path):
    texts = ["The cat sat.", None, "", "The cat sat.", "a▁b"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op13_token_alignment(spark, str(tmp_path)).collect()}
    for i, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in enumerate(brute_alignment(texts)):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want = (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)
        assert want == tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_alignment_of_nothing(spark):
    assert with_link_counts(align_texts(frame(spark, []), BYTE, PIECE)).collect() == []


# -- whitening


def vectors(spark, rows):
    data = [(i, v, 3, [1.0]) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, deviation int, whitened array<double>").repartition(3)


def brute_moments(rows):
    """Distinct whole vectors, exact covariances as fractions."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(len(fit[0]))]
    y = [[n * c - s for c, s in zip(v, sums)] for v in fit]
    covariance = [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return x, n, sums, np.array(covariance, float)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6)) * np.array([9, 5, 3, 2, 1, 0.5])
    made = (rng.normal(size=(300, 6)) @ mix).astype(np.float32).tolist()
    made += made[:40]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 5 + [None]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, [1.0])]
    out, fitted = whiten(vectors(spark, [*enumerate(made), *odd]), components=4)
    x, n, sums, covariance = brute_moments(made)
    got = {r["vec_id"]: r for r in out.collect()}
    assert (fitted.n, fitted.sums) == (n, sums) and set(got) == set(range(len(made)))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert np.allclose(fitted.explained, values / np.trace(covariance), rtol=1e-9)
    want = (np.array(x, float) - np.array(sums) / n) @ axes / np.sqrt(values)
    own = np.array([got[i]["whitened"] for i in range(len(made))])
    assert np.allclose(own * np.sign((own * want).sum(0)), want, atol=1e-7)
    assert fitted.identity_error < 1e-9
    for i, v in enumerate(x):
        assert int(got[i]["deviation"]) == sum((n * c - s) ** 2 for c, s in zip(v, sums))


def test_covariances_are_exact_far_from_zero(spark):
    """Entries near 2^40 that differ by a few units: sums of squares in doubles would lose them."""
    rng = random.Random(8)
    rows = [(i, [float(2**40 + rng.randrange(4)), float(-(2**41) + rng.randrange(1000)), float(rng.randrange(3))]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {tuple(int(64 * c) + 1_000_000 for c in v) for _, v in rows}
    n, sums = len(x), [sum(v[d] for v in x) for d in range(3)]
    _, fitted = whiten(table)
    exact = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x), n**3) for j in range(3)] for i in range(3)]
    values = np.linalg.eigvalsh(np.array(exact, float))[::-1]
    assert np.allclose(fitted.eigenvalues, values, rtol=1e-9) and fitted.sums == sums


def test_dimensions_without_variance_have_no_component(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 3)]) for i in range(12)]
    out, fitted = whiten(vectors(spark, rows))
    assert fitted.n == 3 and len(fitted.eigenvalues) == 1 and fitted.explained[0] == pytest.approx(1)
    same, one = whiten(vectors(spark, [(1, [2.0, 2.0]), (2, [2.0, 2.0])]))
    assert len(one.eigenvalues) == 0 and [list(r["whitened"]) for r in same.collect()] == [[], []]


def test_whitening_of_nothing(spark):
    out, fitted = whiten(vectors(spark, [(1, None)]))
    assert fitted is None and out.collect() == []
    assert fit_whitening(out.select(F.array(F.lit(1)).cast("array<long>").alias("x")).limit(0)) is None


@pytest.mark.parametrize("rows", [[(1, None)], [(i, [float(i % 5), float(i % 7), 0.5 * i]) for i in range(30)]])
def test_whitening_query(spark, tmp_path, rows):
    vectors(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_whitening(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in out) == [(i, c) for i, v in rows if v for c in (1, 2, 3)]
    assert all(r["identity_error"] < 1e-9 and r["n"] == 30 for r in out)


# -- packing on top of the encoder


def test_packing_keeps_columns_of_any_name(spark):
    from riskloom.llm.packing import pack_pieces

    rows = [(i, 5, 9, 9, "p", "g") for i in range(10)] + [(None, 3, 1, 1, None, None), (2**60 + 1, 4, 0, 0, "x", "y")]
    table = spark.createDataFrame(rows, "doc_id long, length long, offset int, sequence_id int, _piece string, _group string")
    out = pack_pieces(table, window=8)
    assert out.columns == ["doc_id", "length", "_piece", "_group", "sequence_id", "offset"]
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r["_piece"] for r in got if r["doc_id"] is not None and r["doc_id"] < 10} == {"p"} and len({(r["sequence_id"], r["offset"]) for r in got}) == 12


def test_packing_with_other_tokenizers(spark, tmp_path):
    """One that joins across blanks, and a byte-level one: ids are the library's."""
    from riskloom.llm.packing import token_pieces

    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "joins.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = odd_texts(21, 40)
    for file in (str(path), BYTE):
        own = Tokenizer.from_file(file)
        got = {r["doc_id"]: bytes(r["ids"]) for r in token_pieces(frame(spark, texts), file, window=10**6).collect()}
        for i, text in enumerate(texts):
            assert got[i] == np.asarray([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
