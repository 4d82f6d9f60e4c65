"""Decontamination, line dedup, substring dedup and near duplicates against brute force."""

from __future__ import annotations

import random

import brute
import pytest

from riskloom.llm import near_dedup
from riskloom.llm.decontaminate import contamination
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from riskloom.llm.substring_dedup import remove_repeated_windows

VOCABULARY = ["Alpha", "beta", "gamma", "Delta,", "épsilon", "zeta", "eta", "the", "of", "a", "iota", "x1", "mu\x0b", "\U0001f600", "lambda"]
SCHEMA = "doc_id long, text string, key string, words string, start int"


def frame(spark, docs, schema=SCHEMA):
    return spark.createDataFrame([(d, t, "k", "w", 1) for d, t in docs], schema)


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(n))


def corpus(seed, n=40):
    """Own text, shared passages, copies, near copies, empty texts and a repeated word."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    docs = []
    for i in range(n):
        parts = [sentence(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        text = rng.choice(["\n", "\n", "  \t"]).join(parts)
        if docs and rng.random() < 0.4:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), "added")
            text = " ".join(words)
        docs.append((i * 3, text))
    docs += [(500, None), (501, ""), (502, " \n\t "), (503, "word"), (504, "WORD"), (505, "the " * 60), (506, "the " * 70)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket_strings", [500, 1])
def test_substring_dedup(spark, seed, bucket_strings):
    docs = [*corpus(seed), (None, corpus(seed)[0][1]), corpus(seed)[3]]
    got = remove_repeated_windows(frame(spark, docs), width=12, seed=4, bucket_strings=bucket_strings).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.kept_words(docs, 12), key=str)


def test_substring_dedup_of_nothing(spark):
    assert remove_repeated_windows(frame(spark, [])).collect() == []
    assert [tuple(r) for r in remove_repeated_windows(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, "")]


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_decontamination(spark, seed, broadcast_rows):
    docs, rng = corpus(seed), random.Random(seed)
    texts = [t for _, t in docs if t and len(t.split()) > 20]
    items = [(i, " ".join(rng.choice(texts).split()[j : j + 14])) for i, j in enumerate(range(8))]
    items += [(20, "word"), (21, None), (22, ""), (23, "alpha beta"), (24, items[0][1]), (24, items[0][1]), (25, "the the the")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    docs = [*docs, (None, texts[0])]
    got = contamination(frame(spark, docs), table, broadcast_rows=broadcast_rows).collect()
    want = brute.contamination(docs, items, 10)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_hit > 0 for r in got) > 3


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [(1, 2, 0, []), (2, 0, 0, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(frame(spark, []), some).collect() == []


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    lines = [sentence(rng, rng.randrange(3, 14)).split(" ") for _ in range(12)]
    docs = []
    for i in range(30):
        own = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(lines))
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["changed", "the"])
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), rng.choice(["added", words[0]]))
            if rng.random() < 0.3:
                del words[rng.randrange(len(words))]
            own.append("  ".join(words))
        docs.append((i, "\n".join(own)))
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, "the " * 9), (94, "the " * 10)]
    got = dedup_lines(frame(spark, docs)).collect()
    assert {r.doc_id: r.text for r in got} == brute.kept_lines(docs, 8)
    assert sum(r.n_removed for r in got) > 10
    assert {r.key for r in got} == {"k"}


def test_every_line_is_deduplicated(spark):
    import corpus_pipeline

    han = "".join(chr(0x4E00 + 7 * i) for i in range(20))
    thai = "".join(chr(0x0E01 + i) for i in range(24))
    rare = "\U00020000\U00020001" * 9
    docs = [
        (1, f"}}\n\nshort line\n{han}\n{thai}\n{rare}\n短い"),
        (2, f"}}\n\nshort  line\nother line\n{han[:5]}新{han[6:]}\n{thai[:-1]}\n短い\n短く"),
        (3, f"}}\nshort lines\n{han[:9]}加{han[9:]}\n{han[::-1]}\nnew {thai[:12]}\n{rare[:4]}\U00020005{rare[5:]}\n{rare[:3]}\U00020005\U00020006{rare[5:]}"),
    ]
    table = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, source string, n_chars long")
    want = {1: docs[0][1], 2: "\nother line\n短く", 3: f"short lines\n{han[::-1]}\nnew {thai[:12]}\n{rare[:3]}\U00020005\U00020006{rare[5:]}"}
    assert {r.doc_id: r.text for r in dedup_lines(table, every_line=True).collect()} == want
    got = corpus_pipeline.lines(spark, table, "")
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {d: (t, 0 if d == 1 else len(t)) for d, t in want.items()}


def test_line_dedup_of_repeated_rows_and_rows_without_id(spark):
    line = "one two three four five six seven eight"
    got = dedup_lines(frame(spark, [(1, line), (1, line), (None, line), (2, line)])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.text) for r in got) == [("1", 0, line), ("1", 0, line), ("2", 1, ""), ("None", 0, line)]
    assert dedup_lines(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [8, 9])
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, seed, size):
    docs = corpus(seed, 60)
    got = near_duplicates(frame(spark, docs), size).collect()
    want = brute.components(docs, size, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(docs) and len({c for _, c in want.values()}) < len(docs) - 3


def test_near_duplicates_in_crowded_buckets(spark):
    """A chain of texts, each near to its neighbours only, and many that are near to none."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(100)] = f"n{i}x{rng.randrange(1000)}"
    got = near_duplicates(frame(spark, docs), 1, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(docs, 1, 80)


@pytest.mark.parametrize("block", [16, 4096])
def test_a_large_group_that_is_near_but_not_linked(spark, monkeypatch, block):
    """No table holds the pairs of the group, which differ in about as many words as the similarity still forbids."""
    rng = random.Random(21)
    base, docs = [f"w{i}" for i in range(120)], []
    for i in range(240):
        copied = i > 0 and i % 12 == 0
        words = docs[i - 2][1].split(" ") if copied else list(base)
        for at in rng.sample(range(120), 3 if copied else 10):
            words[at] = f"n{i}x{at}"
        docs.append((i, " ".join(words)))
    sizes = []
    for name in ("stored", "cut_lineage"):
        keep = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda df, *label, keep=keep: sizes.append((out := keep(df, *label)).count()) or out)
    got = near_duplicates(frame(spark, docs), 1, 80, **({"block": block} if block < 4096 else {})).collect()
    want = brute.components(docs, 1, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 12 < len(docs) - len({c for _, c in want.values()}) < 40
    assert max(sizes) <= 40 * len(docs) or block < 4096


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    text = sentence(random.Random(1), 40).replace("é", "e")
    docs = [(5, text), (3, text), (3, text), (None, text), (None, None), (7, None), (8, None), (9, text.upper())]
    got = drop_near_duplicates(frame(spark, docs)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "7", "8", "None", "None"]
    assert got[0].words == "w"
    assert drop_near_duplicates(frame(spark, [])).collect() == []


def kept_of_any_length(docs):
    """{id: kept text}: equal lines of any length but blank ones go, near ones from eight words on."""
    lines = sorted((d, i, brute.WORD.findall(line)) for d, t in docs if t is not None for i, line in enumerate(t.split("\n")))
    gone = set()
    for k, (d, i, w) in enumerate(lines):
        if w and any(o == w or (min(len(w), len(o)) >= 8 and brute.edits(w, o) <= 1) for _, _, o in lines[:k]):
            gone.add((d, i))
    return {d: t and "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


@pytest.mark.parametrize("seed", [15, 16, 17])
def test_lines_of_every_length(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randrange(1, 12)).split(" ") for _ in range(9)]
    docs = []
    for i in range(25):
        own = []
        for _ in range(rng.randrange(7)):
            words = list(rng.choice(pool))
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["changed", "the", "é"])
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), words[0])
            own.append(rng.choice([" ", " ", "  ", "\t", " \r"]).join(words) + rng.choice(["", "", " ", "\x0b"]))
        docs.append((i, "\n".join(own)))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, docs), every_line=True).collect()}
    assert got == kept_of_any_length(docs)


def test_a_very_long_line(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    other = [*words[:700], "changed", *words[701:]]
    far = [*other[:900], "changed", "too", *other[902:]]
    less = words[:1500] + words[1501:]
    docs = [(i, " ".join(w)) for i, w in enumerate((words, other, far, less, words))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(frame(spark, docs)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}


def test_columns_named_like_helpers_stay(spark):
    names = ["_doc", "_key", "_tk", "_gone", "row", "doc", "tkey", "t", "line_nos", "gone_doc", "g_doc", "n_removed"]
    line = "one two three four five six seven eight"
    rows = [(i, line if i < 3 else "x", *range(len(names))) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = dedup_lines(table)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == table.columns[:-1]
    assert all(tuple(r[n] for n in names[:-1]) == tuple(range(len(names) - 1)) for r in out.collect())
    kept = drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3]
