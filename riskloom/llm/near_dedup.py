"""Near-duplicate documents by tensored MinHash bands.

Two collections of ``bands`` bands of ``rows`` minhashes each are computed per document. Documents that share a band of
the first collection are compared; with the defaults two of exactly the similarity 0.8 share none in 2 of 10,000 cases,
and more alike ones in fewer. Where very many share a band, those are compared that also share one of the second, which
lets as many pairs pass again.

Documents with equal shingle sets are one node. Nodes that share bands of the first collection are first held against the
ends of those bands they share most often, a few pairs a node; a pair is a link if its full shingle sets reach the
similarity. Bands whose members have become one component need no more. Members of the others are compared with one
another inside the task that holds them, by minhashes and then by full sets; what leaves the task are links that join
components there, at most as many as it has members, so that a group whose members are near one another but not linked
writes no pairs out. A band of very many members is divided by the bands of the second collection before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import text_key, without
from riskloom.llm.components import smallest_reachable
from riskloom.llm.storage import stored
from riskloom.llm.wordhash import Words, mix, run_hashes, word_groups
from riskloom.session import cut_lineage

BANDS = 16
ROWS = 4
#: Members of a band that are compared with one another at once, and the hashes of their sets.
BLOCK, BLOCK_HASHES = 4096, 1 << 22
#: Pairs a node has at most with the ends of its bands.
LEADERS = 3


def group_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text, one text after the other, and their offsets."""
    texts = len(words.first) - 1
    count = np.diff(words.first)
    runs = run_hashes(words.hash, size)
    of = np.repeat(np.arange(texts), count)[: len(runs)]
    inside = np.arange(len(runs)) + size <= words.first[of + 1]
    hashes, of = runs[inside], of[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = [run_hashes(words.hash[words.first[i] : words.first[i + 1]], int(count[i]))[0] + np.uint64(count[i]) for i in short]
        hashes, of = np.append(hashes, mix(np.array(whole, np.uint64))), np.append(of, short)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(texts + 1))


def _minhashes(hashes: np.ndarray, offsets: np.ndarray, functions: int) -> np.ndarray:
    """A row of ``functions`` minhashes for each text; all texts have shingles."""
    seeds = mix(np.arange(1, 2 * functions + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out = np.empty((len(offsets) - 1, functions), np.uint64)
    for k in range(functions):
        out[:, k] = np.minimum.reduceat((hashes ^ seeds[k]) * (seeds[functions + k] | np.uint64(1)), offsets[:-1])
    return out


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in word_groups(batch.column(2), lower=True):
                hashes, offsets = group_sets(words, size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                low = np.zeros((to - at, 2 * bands * rows), np.uint64)
                if len(full):
                    low[full] = _minhashes(hashes, np.append(offsets[full], len(hashes)), 2 * bands * rows)
                band = run_bands(low, 2 * bands, rows)
                raw = hashes.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                sketch = mix(low).astype(np.uint8)
                width = np.arange(0, (to - at) * bands + 1, bands, dtype=np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, to - at),
                        batch.column(1).slice(at, to - at),
                        pa.array(n.astype(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(width), pa.array(np.ascontiguousarray(band[:, :bands]).view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(width), pa.array(np.ascontiguousarray(band[:, bands:]).view(np.int64).ravel())),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["doc", "tkey", "n", "digest", "a", "b", "sketch"],
                )

    return run


def run_bands(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` minhashes; equal values in different bands give different hashes."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(low), 1))
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r::rows][:, :bands])
    return out


def least_matches(functions: int, similarity: float) -> int:
    """Equal minhashes below which a pair is four standard deviations short of the similarity."""
    return int(functions * similarity - 4 * (functions * similarity * (1 - similarity)) ** 0.5)


def _alike(matches: int):
    """Pairs (x, y) of rows (x, y, sx, sy) whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= matches)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return run


def _confirm(size: int, percent: int):
    """Pairs (x, y) of Arrow batches (x, y, text of x, text of y) whose full sets reach the similarity."""

    def sets(texts: pa.Array) -> Iterator[np.ndarray]:
        for at, to, words in word_groups(texts, lower=True):
            hashes, offsets = group_sets(words, size)
            for i in range(to - at):
                yield hashes[offsets[i] : offsets[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return run


def _with_sets(size: int):
    """Rows (node, n, sketch, a, b, text) with the sorted shingle hashes in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in word_groups(batch.column(5), lower=True):
                hashes, offsets = group_sets(words, size)
                raw = hashes.tobytes()
                sets = pa.array([raw[8 * i : 8 * j] for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())
                kept = [batch.column(i).slice(at, to - at) for i in range(5)]
                yield pa.record_batch([*kept, sets], names=["node", "n", "sketch", "a", "b", "hashes"])

    return run


class _Sets:
    """Full sets of a few nodes, as numbers of their distinct hashes."""

    def __init__(self, hashes: pd.Series):
        lengths = np.array([len(h) // 8 for h in hashes])
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        distinct, self.number = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many hashes each of ``others`` has in common with ``x``."""
        own = self.number[self.at[x] : self.at[x + 1]]
        self.mark[own] = True
        lengths = self.at[others + 1] - self.at[others]
        starts = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) + np.repeat(self.at[others] - starts, lengths)
        both = np.add.reduceat(self.mark[self.number[places]].astype(np.int64), starts)
        self.mark[own] = False
        return both


def _blocks(matches: int, percent: int):
    """Links between different components, each of which joins two that no other link of its block has joined.

    Rows (band, bi, bj, block, at, bt, node, label, n, sketch, a, b, hashes) are sorted by the first three; ``at`` is the
    place of the band in ``a``, and ``bt`` in ``b`` where it is divided, else -1. A pair is compared in the first band
    that both share.
    """
    columns = ["band", "bi", "bj", "block", "at", "bt", "node", "label", "n"]

    def links(frame: pd.DataFrame) -> list[tuple[int, int]]:
        band, bi, bj, block, at, bt, node, label, n = (frame[c].to_numpy() for c in columns)
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        first, second = np.stack(frame["a"].to_numpy()), np.stack(frame["b"].to_numpy())
        new = (band[1:] != band[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(frame)]])
        out, now = [], label.copy()
        for a, b in zip(edges, edges[1:]):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            within, sets = bi[a] == bj[a], None
            for x in range(a, b):
                if block[x] != bi[a]:
                    continue
                # inside one block a pair is met once, from its first row
                others = np.arange(x + 1 if within else a, b)
                fits = (now[others] != now[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))
                others = others[fits if within else fits & (block[others] != bi[a])]
                others = others[(sketch[others] == sketch[x]).sum(axis=1) >= matches]
                others = others[(first[others] == first[x]).argmax(axis=1) == at[x]]
                if bt[x] >= 0:
                    others = others[(second[others] == second[x]).argmax(axis=1) == bt[x]]
                if not len(others):
                    continue
                if sets is None:
                    sets = _Sets(frame["hashes"].iloc[a:b])
                both = sets.common(x - a, others - a)
                for o in others[100 * both >= percent * (n[others] + n[x] - both)]:
                    if now[o] != now[x]:
                        out.append((min(node[x], node[o]), max(node[x], node[o])))
                        now[a:b][now[a:b] == now[o]] = now[x]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held[["band", "bi", "bj"]].to_numpy()
            whole = len(held) - int((last == last[-1]).all(axis=1)[::-1].cumprod().sum())
            if whole:
                yield pd.DataFrame(links(held.iloc[:whole]), columns=["x", "y"]).astype("int64")
                held = held.iloc[whole:]
        if held is not None:
            yield pd.DataFrame(links(held), columns=["x", "y"]).astype("int64")

    return run


class _Search:
    """The nodes of one run, their texts and the links found so far."""

    def __init__(self, nodes: DataFrame, size: int, percent: int, matches: int):
        self.nodes, self.size, self.percent, self.matches = nodes, size, percent, matches
        self.texts: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow the similarity."""
        side = self.nodes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
        other = self.nodes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
        fits = 100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny")
        joined = pairs.join(side, "x").join(other, "y").filter(fits).select("x", "y", "sx", "sy")
        return joined.mapInArrow(_alike(self.matches), "x long, y long")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare full sets and renew the components."""
        tx = self.texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
        ty = self.texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
        joined = pairs.select("x", "y").join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty")
        self.add(joined.mapInArrow(_confirm(self.size, self.percent), "x long, y long"))

    def add(self, links: DataFrame) -> None:
        links = cut_lineage(links)
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = smallest_reachable(self.links)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with the ``label`` of their node."""
        return rows.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _shared(nodes: DataFrame) -> DataFrame:
    """Rows (band, node, n, at, lo, hi) of the first collection's bands that two nodes or more share."""
    bands = nodes.select("node", "n", F.posexplode("a").alias("at", "band"))
    met = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    return bands.join(met, "band")


def _leaders(shared: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of each node and the ends that it shares most bands with."""
    ends = shared.select("node", F.explode(F.array("lo", "hi")).alias("end")).filter("node != end").groupBy("node", "end").agg(F.count("*").alias("c"))
    most = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("c"), F.col("end")))), 1, LEADERS)  # at most twice as many ends as a node has bands
    pairs = ends.groupBy("node").agg(most.alias("most")).select("node", F.explode("most.end").alias("end"))
    return pairs.select(F.least("node", "end").alias("x"), F.greatest("node", "end").alias("y")).distinct()


def _open(placed: DataFrame, block: int) -> DataFrame:
    """Rows of bands with members of several components, with the band's number of members and of blocks."""
    met = placed.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("_n") / BLOCK_HASHES)).cast("int")
    return placed.join(met.filter("_lo < _hi").select("band", "members", blocks.alias("blocks")), "band")


def _dealt(shared: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Rows (band, bi, bj, block, at, bt, node, label): members of open bands, once for each pair of blocks that holds theirs."""
    placed = cut_lineage(_open(shared, block))
    crowded = placed.filter(F.col("members") > block).select("band", "at", "node", "n", "label").join(nodes.select("node", "b"), "node")
    crowded = crowded.select("at", "node", "n", "label", "band", F.posexplode("b").alias("bt", "_b")).withColumn("band", F.xxhash64("band", "_b")).drop("_b")
    wanted = ["band", "blocks", "at", "bt", "node", "label"]
    rows = placed.filter(F.col("members") <= block).withColumn("bt", F.lit(-1)).select(wanted).unionByName(_open(crowded, block).select(wanted))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "at", "bt", "node", "label"
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Per different row (id, text) of ``docs``: its id, ``text_key``, ``n_shingles``, ``component_id``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``shingle`` consecutive words
    (A-Z lowered, separated by ASCII white space; a text of fewer words is one shingle). ``component_id`` is the
    smallest id reachable over links. Null, empty and blank texts have no shingles and are linked with nothing, nor are
    rows without an id, whose component is null. An id with several texts is one document to which copies of any of its
    texts belong; near copies are looked for from one of them. Further columns are ignored. Ids are whole numbers.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    schema = "doc long, tkey long, n long, digest binary, a array<long>, b array<long>, sketch binary"
    sigs = stored(texts.mapInArrow(_signatures(shingle, bands, rows), schema), "signatures")
    known = sigs.filter("n > 0 and doc is not null")
    classes = cut_lineage(known.groupBy("digest", "n").agg(F.min("doc").alias("node")).select("digest", "node"))
    first = known.join(classes, "digest").filter("doc = node").groupBy("node").agg(F.min_by(F.struct("tkey", "n", "a", "b", "sketch"), "tkey").alias("f"))
    nodes = stored(first.select("node", "f.*"), "nodes")
    matches = least_matches(2 * bands * rows, percent / 100)
    shared = stored(_shared(nodes), "bands")
    search = _Search(nodes, shingle, percent, matches)
    own = shared.select("node").distinct().join(nodes.select("node", "tkey"), "node").withColumnRenamed("tkey", "_k")
    own = texts.join(own.hint("shuffle_hash"), (F.col("doc") == F.col("node")) & (F.col("tkey") == F.col("_k")))
    search.texts = stored(own.select("node", "text").dropDuplicates(["node"]), "node-texts")
    search.confirm(cut_lineage(search.likely(_leaders(shared))))

    dealt = cut_lineage(_dealt(search.labelled(shared.select("band", "node", "n", "at")), nodes, block))
    apart = nodes.join(dealt.select("node").distinct(), "node").join(search.texts, "node").select("node", "n", "sketch", "a", "b", "text")
    apart = stored(apart.mapInArrow(_with_sets(shingle), "node long, n long, sketch binary, a array<long>, b array<long>, hashes binary"), "apart")
    whole = dealt.join(apart, "node").select("band", "bi", "bj", "block", "at", "bt", "node", "label", "n", "sketch", "a", "b", "hashes")
    sorted_ = whole.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    search.add(sorted_.mapInPandas(_blocks(matches, percent), "x long, y long"))

    labels = classes.join(search.labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    out = sigs.filter("n > 0 and doc is not null").join(labels, "digest").select("doc", "tkey", "n", "label")
    alone = sigs.filter("n = 0 or doc is null").select("doc", "tkey", "n", F.col("doc").alias("label"))
    return out.unionByName(alone).distinct().select(
        F.col("doc").alias(id_col), F.col("tkey").alias("text_key"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns as they are.

    See ``near_duplicates``. Rows without an id stay.
    """
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    return without(docs, found.filter(F.col(id_col) != F.col("component_id")), id_col, text_col)
