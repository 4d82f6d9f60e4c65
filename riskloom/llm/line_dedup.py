"""Removal of lines that repeat or nearly repeat an earlier line, as a deletion-neighbourhood join.

Two lines are near when one changed, added or left-out word turns one into the other. Every line of at least
``min_words`` words emits its variants with one word left out as hashed keys. Lines that differ in one word share the
variant *and* the place of the word; a line that has one word more shares a variant with the other line itself. So the
earliest line of a key is near to all lines of that key, and no key needs its pairs written out.

Variants are only emitted where a partner can exist. An edit leaves either the first or the second half of a line as it
was, so a line that shares neither half with a line of its own length or of one word less or more has no partner, and a
line that shares its first half needs no variants of that half. As a first sieve, near lines of at least eight words
share their first four or their last four words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import SPACES, text_key, wide_hash, words_between
from riskloom.operators.once import compute_once
from riskloom.llm.storage import stored

MIN_WORDS = 8
EDGE = 4
# All but letters of scripts that are written without blanks.
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _between_blanks(line: Column) -> Column:
    """The words of a line between single blanks; most lines are written so already and are not split for it."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.array_join(words_between(line, SPACES), " ")).otherwise(line)


def _many(whole: Column, min_words: int) -> Column:
    return F.substring_index(whole, " ", min_words - 1) != whole


def _unspaced(whole: Column, min_words: int) -> Column:
    """Whether a line has few words but twice as many letters, three bytes each at least, of scripts without blanks."""
    wide = F.octet_length(whole) - F.length(whole) >= 4 * min_words
    return ~_many(whole, min_words) & wide & (F.length(F.regexp_replace(whole, UNSPACED, "")) >= 2 * min_words)


def _characters(whole: Column) -> Column:
    return F.regexp_extract_all(F.replace(whole, F.lit(" "), F.lit("")), F.lit("(?s)."), F.lit(0))


def _units(whole: Column, min_words: int) -> Column:
    """What a line that is judged for near ones is compared by: its words, or its characters."""
    return F.when(_many(whole, min_words), F.split(whole, " ")).otherwise(_characters(whole))


def _edges(whole: Column, min_words: int, every_line: bool) -> tuple[Column, Column]:
    """Short hashes of the first and the last few units of a line that is judged for near ones, else null."""
    many, few = _many(whole, min_words), F.lit(every_line) & _unspaced(whole, min_words)
    ends = []
    for side, at in ((1, 1), (-1, -EDGE)):
        words = F.substring_index(whole, " ", side * EDGE)
        ends.append(F.hash(F.when(many, words).otherwise(F.array_join(F.slice(_characters(whole), at, EDGE), " "))))
    return tuple(F.when(many | few, e) for e in ends)


def _lines(docs: DataFrame, min_words: int, every_line: bool) -> DataFrame:
    """``doc``, ``tkey``, ``line_no`` and ``whole`` of every line to judge; ``whole`` has its words between single blanks."""
    lines = docs.select("doc", "tkey", F.posexplode(F.split("_t", "\n")).alias("line_no", "_line"))
    whole = compute_once(lines, ["doc", "tkey", "line_no"], _between_blanks(F.col("_line")), "whole")
    return whole.filter(F.col("whole") != "" if every_line else _many(F.col("whole"), min_words))


def _shared(lines: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that several different lines have."""
    return lines.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit(True).alias(f"{key}_shared"))


def _alike(a: Column, b: Column) -> Column:
    """How many units both have in common from the start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one changed, added or left-out unit turns ``a`` into ``b``: what they share at both ends leaves no more."""
    shared = _alike(a, b) + _alike(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (shared >= F.greatest(F.size(a), F.size(b)) - 1)


def _halves(candidates: DataFrame, min_words: int) -> DataFrame:
    """``id``, ``kind`` (which half, and whether of the length of one word less) of halves that several lines share."""
    words, n = F.col("words"), F.size("words")
    halves = []
    for longer in (0, 1):
        size = n - longer
        half = F.floor(size / 2).cast("int")
        fits = size >= min_words
        halves += [
            F.when(fits & F.col("head_shared"), F.struct(F.lit(f"head{longer}").alias("kind"), wide_hash(F.lit("head"), size, F.concat_ws(" ", F.slice(words, F.lit(1), half))).alias("key"))),
            F.when(fits & F.col("tail_shared"), F.struct(F.lit(f"tail{longer}").alias("kind"), wide_hash(F.lit("tail"), size, F.concat_ws(" ", F.slice(words, half - size, size - half))).alias("key"))),
        ]
    rows = candidates.select("id", F.explode(F.array_compact(F.array(*halves))).alias("h")).select("id", "h.kind", "h.key")
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    return rows.join(shared, "key").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _near(candidates: DataFrame, min_words: int) -> DataFrame:
    """``id`` of each line with an earlier near line; ``candidates``: id, rank, words, and which edges are shared."""
    kinds = ("head0", "tail0", "head1", "tail1")
    rank = F.struct("rank.doc", "rank.line_no", "rank.id").alias("rank")
    lines = candidates.join(_halves(candidates, min_words), "id")
    lines = stored(lines.select(rank, "words", F.array_join("words", " ").alias("joined"), *[F.array_contains("kinds", k).alias(k) for k in kinds]), "near-lines")
    words, n = F.col("words"), F.size("words")
    half, less = F.floor(n / 2), F.floor((n - 1) / 2)
    # Units have no blanks in them, so what is left of a line without one unit is two ends of its text.
    text = F.col("joined")

    def left(p: Column) -> Column:
        before, after = (F.call_function("substring_index", text, F.lit(" "), count) for count in (p, p + 1 - n))
        return F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))

    def variant(p: Column) -> Column:
        return F.struct(
            p.alias("place"),
            wide_hash(left(p)).alias("variant"),
            ((F.col("head0") & (p >= half)) | (F.col("tail0") & (p < half))).alias("changed"),
            ((F.col("head1") & (p >= less)) | (F.col("tail1") & (p <= less))).alias("left_out"),
        )

    wanted = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda p: ((F.col("head0") | F.col("head1")) & (p >= less)) | ((F.col("tail0") | F.col("tail1")) & (p <= half)),
    )
    variants = stored(lines.select("rank", F.inline(F.transform(wanted, variant))), "variants")
    same = variants.filter("changed").select("rank", "variant", "place")
    first = same.groupBy("variant", "place").agg(F.min("rank").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    changed = same.join(first, ["variant", "place"]).filter(F.col("rank") > F.col("first")).select(F.col("rank.id").alias("id"), F.col("first.id").alias("other"))
    whole = lines.filter("head0 or tail0").select(wide_hash(text).alias("variant"), F.col("rank").alias("_rank"))
    met = variants.filter("left_out").select("rank", "variant").join(whole, "variant")
    later = F.col("rank") > F.col("_rank")
    mine, theirs = F.col("rank.id"), F.col("_rank.id")
    added = met.select(F.when(later, mine).otherwise(theirs).alias("id"), F.when(later, theirs).otherwise(mine).alias("other"))
    pairs = changed.unionByName(added).distinct()
    a = lines.select(F.col("rank.id").alias("id"), F.col("words").alias("a"))
    b = lines.select(F.col("rank.id").alias("other"), F.col("words").alias("b"))
    return pairs.join(a, "id").join(b, "other").filter(_one_edit(F.col("a"), F.col("b"))).select("id").distinct()


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, every_line: bool = False
) -> DataFrame:
    """``doc``, ``tkey`` and ``line_nos`` (from 0) of the lines that an equal or near line precedes.

    Lines are ordered by document id, then line number, and judged on the input: a removed line still removes later
    ones. Documents without an id take no part, nor do lines of fewer than ``min_words`` words; with ``every_line`` only
    blank lines take none, and of lines with fewer words those with at least twice as many letters of scripts without
    blanks are near by characters, the rest only removed if equal.
    """
    if min_words < 2 * EDGE:
        raise ValueError(f"lines of fewer than {2 * EDGE} words can't be compared by their edges")
    texts = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("_t")).filter("doc is not null and _t is not null")
    head, tail = _edges(F.col("whole"), min_words, every_line)
    seen = stored(
        _lines(texts, min_words, every_line).select(
            "doc", "tkey", "line_no", wide_hash(F.col("whole")).alias("id"), head.alias("head"), tail.alias("tail")
        ),
        "lines",
    )
    lines = stored(
        seen.groupBy("id").agg(
            F.min(F.struct("doc", "line_no", "id", "tkey")).alias("rank"), F.count("*").alias("copies"), F.max("head").alias("head"), F.max("tail").alias("tail")
        ),
        "different-lines",
    )
    hopeful = (
        lines.join(_shared(lines, "head"), "head", "left").join(_shared(lines, "tail"), "tail", "left")
        .filter("head_shared or tail_shared")
        .select("id", "rank", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("head_shared", "tail_shared")))
    )
    wanted = hopeful.groupBy(F.col("rank.doc").alias("doc"), F.col("rank.tkey").alias("tkey")).agg(
        F.collect_list(F.struct(F.col("rank.line_no").alias("line_no"), "id", "rank", "head_shared", "tail_shared")).alias("wanted")
    )
    candidates = (
        texts.join(wanted, ["doc", "tkey"])
        .select(F.split("_t", "\n").alias("_lines"), F.explode("wanted").alias("w"))
        .select("w.*", F.transform(F.array(_between_blanks(F.get("_lines", F.col("w.line_no")))), lambda w: _units(w, min_words))[0].alias("words"))
        .select("id", "rank", "words", "head_shared", "tail_shared")
    )
    candidates = stored(candidates, "candidates")
    near = _near(candidates, min_words).select("id", F.lit(True).alias("near"))
    judged = lines.join(near, "id", "left").filter("copies > 1 or near").select("id", "rank", F.coalesce("near", F.lit(False)).alias("near"))
    later = F.col("near") | (F.col("doc") != F.col("rank.doc")) | (F.col("line_no") != F.col("rank.line_no"))
    return seen.join(judged, "id").filter(later).groupBy("doc", "tkey").agg(F.collect_set("line_no").alias("line_nos"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, every_line: bool = False
) -> DataFrame:
    """The documents, all columns kept, their text without repeated lines; ``n_lines`` and ``n_removed`` are added.

    A line goes if an equal line, or one that a single word edit turns into it, precedes it (smaller id, or same
    document and smaller line number). Words are separated by white space and compared as they are. Lines of fewer than
    ``min_words`` words stay, unless ``every_line``: then equal lines of any length but blank ones go, and long lines
    without blanks are compared by characters. Null texts stay null with no lines; the empty text is one empty line. Rows repeated with
    id and text remain and are judged alike; documents without an id neither lose lines nor cost others theirs.
    Added columns replace columns of the same names.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words, every_line).withColumnsRenamed({"doc": "g_doc", "tkey": "g_key"})
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(id_col).alias("doc"), F.col(text_col).alias("t"), text_key(F.col(text_col)).alias("tkey"))
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("doc") == F.col("g_doc")) & (F.col("tkey") == F.col("g_key")), "left")
    lines = F.split("t", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("line_nos", i))
    text = F.when(F.col("line_nos").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    own = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *own,
        F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("line_nos"), F.lit(0)).cast("long").alias("n_removed"),
    )
