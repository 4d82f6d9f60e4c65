"""Records of large JSON page files, found by byte range.

A page file is one JSON object with a long list of records in it. It is read as text that ends at every closing brace, which
Spark splits into byte ranges by itself. Whether a piece lies inside a string, and how deep, follows from counts of quotes
and brackets before it; these are added up per range, carried from range to range, and run on within each. A record
ends where the depth falls back to that of the list, and is joined from its pieces. No task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

ENDING = "}"
# Strings, numbers and words between two elements, each with its comma.
_PLAIN = r'(?:\s*(?:"(?:[^"\\]++|\\.)*+"|[^\s,"{}\[\]]++)\s*,)*+\s*'
# A comma, then the next element of the same list.
_NEXT = r"(?s)^\s*," + _PLAIN + r"(\{.*)$"


def _first_of(section: str) -> str:
    """The first element of the list called ``section``: strings before it are stepped over whole."""
    return r'(?s)^(?:[^"]*+"(?:[^"\\]++|\\.)*+")*?[^"]*?"' + section + r'"\s*:\s*\[' + _PLAIN + r"(\{.*)$"


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


#: A range of a file: so many pieces of one byte range, 65,536 at most, so that no task sorts a byte range whole.
SLICE_BITS = 16
_RANGE = ["_path", "_block", "_slice"]


def _here(order: str) -> Window:
    return Window.partitionBy(*_RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ranges_before() -> Window:
    return Window.partitionBy("_path").orderBy("_block", "_slice").rowsBetween(Window.unboundedPreceding, -1)


def _before(value: Column) -> Column:
    """The total of ``value`` over the ranges before each in its file."""
    return F.coalesce(F.sum(value).over(_ranges_before()), F.lit(0))


def _latest(rows: DataFrame, value: str, out: str, order: str = "_line") -> DataFrame:
    """``rows`` with the last value up to each that is not null, along each file."""
    carried = rows.groupBy(*_RANGE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")).select(
        *_RANGE, F.last("_end", ignorenulls=True).over(_ranges_before()).alias("_carry")
    )
    local = rows.withColumn("_in", F.last(value, ignorenulls=True).over(_here(order)))
    return local.join(carried, _RANGE).withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry")


def _in_order(pieces: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["_text"]), "")


def page_records(spark: SparkSession, path: str, section: str = "vulnerabilities") -> DataFrame:
    """``_file``, ``_pos`` and ``_json`` of every object in the list ``section`` of each file's outermost object.

    ``_pos`` rises in the order of records. Elements that are no objects are left out. A file that is cut off gives the
    records that are whole; a file that holds something else gives none. Compressed files are read one task each.
    """
    text = spark.read.option("lineSep", ENDING).text(path).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("_text"),
    )
    # Escapes occur in strings only, and no piece ends inside one: what a backslash escapes is never a brace. All that counts
    # of a piece is its quotes and brackets.
    marks = F.regexp_replace("_text", r'(?s)\\.?+|[^"{\[\]\\]++', "")
    strings = r'"[^"]*+(?:"|$)'
    bare = text.withColumn("_slice", F.shiftright("_line", SLICE_BITS)).withColumn("_marks", marks)
    quotes = _count(F.col("_marks"), '"')
    odd = F.pmod(quotes, F.lit(2))

    def change(outside: Column, ends_outside: Column) -> Column:
        """What a piece and the brace at its end add to the depth."""
        return 2 * F.length(F.replace(outside, F.lit("]"), F.lit(""))) - F.length(outside) - ends_outside

    from_outside = F.regexp_replace("_marks", strings, "")
    from_inside = F.regexp_replace(F.regexp_replace("_marks", r'^[^"]*+(?:"|$)', ""), strings, "")
    counted = bare.select(
        *_RANGE, "_file", "_line", "_text", quotes.alias("_quotes"), change(from_outside, 1 - odd).alias("_a"), change(from_inside, odd).alias("_b")
    )
    # Whether a range starts inside a string is not known yet, so the depth is followed for both cases: from outside, inside.
    upto = counted.withColumn("_upto", F.sum("_quotes").over(_here("_line")))
    turned = F.pmod(F.col("_upto") - F.col("_quotes"), F.lit(2)) == 1
    pieces = cut_lineage(
        upto.select(
            *_RANGE, "_file", "_line", "_text", "_quotes", F.pmod("_upto", F.lit(2)).alias("_odd"),
            F.when(turned, F.col("_b")).otherwise(F.col("_a")).alias("_a"), F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias("_b"),
        )
    )
    totals = pieces.groupBy(*_RANGE).agg(*[F.sum(c).alias(c) for c in ("_quotes", "_a", "_b")])
    started = totals.withColumn("_inside", F.pmod(_before(F.col("_quotes")), F.lit(2)))
    change_here = F.when(F.col("_inside") == 1, F.col("_b")).otherwise(F.col("_a"))
    known = started.select(*_RANGE, "_inside", _before(change_here).alias("_deep"))
    deep = pieces.join(known, _RANGE).withColumn("_depth", F.col("_deep") + F.sum(change_here).over(_here("_line")))
    ends = ((F.col("_depth") == 2) & (F.col("_odd") == F.col("_inside"))).cast("long")
    numbered = deep.withColumn("_ends", ends).withColumn("_record", F.sum("_ends").over(_here("_line")) - F.col("_ends"))
    # A record's pieces come together, first those of one range, where they lie already; its last piece says where it stands.
    parts = cut_lineage(
        numbered.groupBy(*_RANGE, "_file", "_record").agg(
            _in_order(F.collect_list(F.struct("_line", F.concat("_text", F.lit(ENDING)).alias("_text")))).alias("_text"),
            F.max("_ends").alias("_ends"),
            F.max("_line").alias("_line"),
        )
    )
    done = parts.groupBy(*_RANGE).agg(F.sum("_ends").alias("_ends")).select(*_RANGE, _before(F.col("_ends")).alias("_done"))
    joined = parts.join(done, _RANGE).withColumn("_record", F.col("_done") + F.col("_record")).groupBy("_path", "_file", "_record").agg(
        _in_order(F.collect_list(F.struct("_block", "_slice", "_line", "_text"))).alias("_whole"),
        F.max("_ends").alias("_complete"),
        F.max(F.struct("_block", "_slice", "_line")).alias("_at"),
    )
    records = joined.where("_complete = 1").select("_path", "_file", "_record", *[F.col(f"_at.{c}").alias(c) for c in ("_block", "_slice", "_line")], "_whole")
    follows = F.rlike("_whole", F.lit(_NEXT))
    begins = F.regexp_extract("_whole", _first_of(section), 1)
    found = F.struct(
        F.when(~follows, begins != "").alias("starts"),
        F.when(follows, F.regexp_extract("_whole", _NEXT, 1)).otherwise(begins).alias("json"),
    )
    parsed = records.select(*_RANGE, "_file", "_record", "_line", F.explode(F.array(found)).alias("_f"))
    parsed = cut_lineage(parsed.select(*_RANGE, "_file", "_record", "_line", F.col("_f.starts").alias("_starts"), F.col("_f.json").alias("_json")))
    within = _latest(parsed.drop("_json"), "_starts", "_within").where("_within").select("_path", "_record")
    return parsed.join(within, ["_path", "_record"]).select("_file", F.struct("_record").alias("_pos"), "_json")
