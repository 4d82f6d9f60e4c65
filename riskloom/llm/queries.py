"""The operators of this subpackage over the supplied tables, with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.alignment import align_texts, with_link_counts
from riskloom.llm.bpe import decode_ids, encode_texts
from riskloom.llm.chat import format_chats, parse, unescape
from riskloom.llm.decontaminate import contamination
from riskloom.llm.html_extract import extract_text
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.near_dedup import near_duplicates
from riskloom.llm.neighbours import nearest
from riskloom.llm.packing import pack_pieces, token_pieces
from riskloom.llm.quality import quality_scores
from riskloom.llm.substring_dedup import remove_repeated_windows
from riskloom.llm.url_filter import Rule, judge_urls
from riskloom.llm.whitening import whiten

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
TRICKY = r"\### Assistant: </turn> ok"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    out = extract_text(_table(spark, folder, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated_windows(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(_table(spark, folder, "documents"), tokenizer_path())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(digests)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(_table(spark, folder, "documents"), every_line=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of formatted conversations, from the formatted text and the spans alone."""
    for batch in batches:
        turns, learned = [], []
        for formatted, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parse(formatted)).encode()).hexdigest())
            learned.append("".join(unescape(formatted[s["from"] : s["to"]]) for s in spans))
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(turns, pa.string()),
                pa.array(map(len, learned), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in learned], pa.string()),
                pa.array([len(f) for f in batch.column(2).to_pylist()], pa.int64()),
            ],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    events = rows.unionByName(added).select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), F.lit(None).cast("string").alias("message"), F.lit("message").alias("kind"), "role", "text"
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_chats(events).mapInArrow(_read_back, schema)


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(_table(spark, folder, "documents"), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"), "id % 20 = 0").select("query_id", "rank", "vec_id", "score")


def op11_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    tokens = encode_texts(_table(spark, folder, "documents"), tokenizer_path())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    measured = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    out = decode_ids(measured, tokenizer_path(), keep=["doc_id", "n_tokens", "ids_sha256"])
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    out, fitted = whiten(_table(spark, folder, "embeddings"))
    explained = F.array(*(F.lit(float(e)) for e in fitted.explained)) if fitted else F.array().cast("array<double>")
    rows = out.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n if fitted else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    aligned = align_texts(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = with_link_counts(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (win), range(0, 50) r(j) WHERE first < doc_id
),
per_doc AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce((SELECT string_agg(w[g.p], ' ' ORDER BY g.p) FROM (SELECT unnest(range(1, len(w) + 1)) AS p) g
      WHERE NOT list_contains(ps, g.p)), '') END) AS kept_sha256
FROM d LEFT JOIN per_doc USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

# Lines are near by the definition itself here: pairs that share an edge, compared by their words.
OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
),
judged AS (
  SELECT doc_id, i, array_to_string(w, ' ') AS norm, doc_id * 1000000 + i AS rank,
    CASE WHEN len(w) >= 8 THEN w
      WHEN len(regexp_extract_all(line, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) >= 16
      THEN regexp_extract_all(array_to_string(w, ''), '(?s).') END AS w
  FROM l WHERE len(w) >= 1
),
firsts AS (SELECT norm, min(rank) AS rank, any_value(w) AS w FROM judged GROUP BY norm),
pairs AS (
  SELECT a.norm, a.w AS x, b.w AS y FROM firsts a JOIN firsts b ON a.w[1:4] = b.w[1:4] AND b.rank < a.rank
  UNION
  SELECT a.norm, a.w, b.w FROM firsts a JOIN firsts b ON a.w[-4:] = b.w[-4:] AND b.rank < a.rank
),
near AS (
  SELECT DISTINCT norm FROM pairs
  WHERE (len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) = 1)
    OR (len(x) = len(y) + 1 AND len(list_filter(range(1, len(x) + 1), lambda p: x[1:p - 1] || x[p + 1:] = y)) > 0)
    OR (len(y) = len(x) + 1 AND len(list_filter(range(1, len(y) + 1), lambda p: y[1:p - 1] || y[p + 1:] = x)) > 0)
),
gone AS (
  SELECT j.doc_id, j.i FROM judged j JOIN firsts f USING (norm) LEFT JOIN near n USING (norm)
  WHERE j.rank > f.rank OR n.norm IS NOT NULL
)
SELECT d.doc_id, coalesce(count(l.i), 0) AS n_lines, count(g.i) AS n_removed,
  sha256(CASE WHEN any_value(d.text) IS NULL THEN NULL
    ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)) AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
low AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_substring_dedup,
        op3_url_filter,
        op4_decontamination,
        op5_packing,
        op6_line_dedup,
        op7_quality_classifier,
        op8_chat_formatting,
        op9_near_dedup,
        op10_nearest_neighbours,
        op11_bpe_encoding,
        op12_whitening,
        op13_token_alignment,
    )
}
ORACLES = {"op2_substring_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op9_near_dedup": OP9_SQL}
