"""Approximate nearest neighbours by largest inner product: NN-descent builds the graph, greedy search walks it.

Equal vectors are one node. The graph starts from two rounds of random blocks, in each of which every node meets all
others of its block. Then neighbours of neighbours are joined: a node's list and a bounded draw of those that list it
are brought together with their vectors, every pair of them of which one is fresh is compared, and the best are offered
to both ends. This goes on until few lists change. Every node has two lists: its nearest by angle, which connect nodes of
all lengths, and its best by plain inner product, which lead to long vectors. Nodes of like direction have like best
ones, so the same joins find both.

A search starts at given nodes and keeps the best ``beam`` nodes met. Each step expands the nearest ones not expanded
yet, all queries at once: links are joined by node, new nodes are scored where the vectors lie (dealt in blocks of
bounded size), and the scores return to their query. It ends when every query's beam has been expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.columns import wide_hash
from riskloom.llm.storage import stored
from riskloom.llm.wordhash import mix

LINKS = 40
PLAIN = 20
REVERSE = 40
OFFERS = 10
BLOCK = 1024
BEAM = 120
STEP = 40
#: Vectors scored together in one task.
SHARD = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``vec`` (doubles) of the vectors that take part; an id given several times counts with the smallest."""
    vec = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(sound)
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    rows = rows.filter(F.size("vec") == (common["d"] if common else 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        keys = table.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _lists(size: int, plain_size: int):
    """Each node's best by angle and by inner product: two sets of lists, of sorted rows (v, w, score, fresh, plain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            *columns, plain = (table.column(i).to_numpy() for i in range(5))
            nodes, lists = np.unique(columns[0]), []
            for of_kind, most in ((~plain, size), (plain, plain_size)):
                v, w, s, fresh = (c[of_kind] for c in columns)
                order = np.lexsort((fresh, w, v))  # of equal pairs the known one comes first
                v, w, s, fresh = v[order], w[order], s[order], fresh[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                v, w, s, fresh = v[new], w[new], s[new], fresh[new]
                order = np.lexsort((w, -s, v))
                v, w, s, fresh = v[order], w[order], s[order], fresh[order]
                best = np.arange(len(v)) - np.searchsorted(v, v) < most
                v, w, s, fresh = v[best], w[best], s[best], fresh[best]
                offsets = pa.array(np.append(np.searchsorted(v, nodes), len(v)).astype(np.int32))
                lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w, s, fresh)]
            yield pa.record_batch([pa.array(nodes), *lists], names=["node", "links", "scores", "fresh", "plain", "plain_scores", "plain_fresh"])

    return run


def _vectors(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 8:].copy().view(np.float32), raw[:, :8].copy().view(np.float64)[:, 0]


def _best(scores: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the ``take`` highest of each row, without those of minus infinity."""
    top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
    best = np.take_along_axis(scores, top, 1)
    row, at = np.nonzero(best > -np.inf)
    return row, top[row, at], best[row, at]


def _offers(size: int):
    """Pairs worth offering: rows (v, w, score, plain) of rows (u, v, fresh, low, plain_low, code) sorted by u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            u, v, fresh, *lows = (table.column(i).to_numpy() for i in range(5))
            x, length = _vectors(table.column(5).to_pylist())
            found = []
            for a, b in zip(edges := np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u)), edges[1:]):
                ids, first = np.unique(v[a:b], return_index=True)
                if len(ids) < 2:
                    continue
                own, new = x[a:b][first], np.zeros(len(ids), bool)
                np.logical_or.at(new, np.searchsorted(ids, v[a:b]), fresh[a:b])
                cosines = (own @ own.T).astype(np.float64)
                for plain, low in enumerate(lows):
                    scores = cosines * length[a:b][first] if plain else cosines.copy()
                    np.fill_diagonal(scores, -np.inf)
                    scores[np.ix_(~new, ~new)] = -np.inf
                    scores[scores <= low[a:b][first][:, None]] = -np.inf
                    row, column, best = _best(scores, min(size, len(ids) - 1))
                    found.append((ids[row], ids[column], best, np.full(len(row), bool(plain))))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], names=["v", "w", "score", "plain"])

    return run


def _block(size: int, plain_size: int):
    """Each node's best of its block, by angle and by inner product."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["node"].to_numpy()
        x, length = _vectors(frame["code"].tolist())
        cosines = (x @ x.T).astype(np.float64)
        parts = []
        for plain, most in enumerate((size, plain_size)):
            scores = cosines * length if plain else cosines.copy()
            np.fill_diagonal(scores, -np.inf)
            row, column, best = _best(scores, min(most, max(1, len(ids) - 1)))
            parts.append(pd.DataFrame({"v": ids[row], "w": ids[column], "score": best, "plain": bool(plain)}))
        return pd.concat(parts)

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths in double, then directions in single precision."""
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column(1).to_pylist())
            largest = np.abs(x).max(axis=1, keepdims=True)
            scaled = np.linalg.norm(x / largest, axis=1, keepdims=True)
            rows = zip((largest * scaled).astype(np.float64), (x / largest / scaled).astype(np.float32))
            yield pa.record_batch([batch.column(0), pa.array([n.tobytes() + r.tobytes() for n, r in rows], pa.binary())], names=["node", "code"])


def _merged(candidates: DataFrame, codes: DataFrame, links: int, plain: int, name: str) -> DataFrame:
    """Stored lists of rows (v, w, score, fresh, plain), with the codes of their nodes."""
    rows = candidates.select("v", "w", "score", "fresh", "plain").repartition("v").sortWithinPartitions("v")
    schema = "node long, links array<long>, scores array<double>, fresh array<boolean>, plain array<long>, plain_scores array<double>, plain_fresh array<boolean>"
    return stored(rows.mapInArrow(_lists(links, plain), schema).join(codes, "node"), name)


def _edges(graph: DataFrame) -> DataFrame:
    """``v``, ``w``, ``score``, ``fresh``, ``plain``: the entries of both lists of every node."""

    def of(plain: bool) -> DataFrame:
        names = [F.col(f"plain_{n}" if plain else n).alias(n) for n in ("scores", "fresh")]
        lists = graph.select("node", F.col("plain" if plain else "links").alias("w"), *names)
        rows = lists.select(F.col("node").alias("v"), F.explode(F.arrays_zip("w", "scores", "fresh")).alias("e"))
        return rows.select("v", "e.w", F.col("e.scores").alias("score"), "e.fresh", F.lit(plain).alias("plain"))

    return of(False).unionByName(of(True))


def build_graph(
    nodes: DataFrame, links: int = LINKS, reverse: int = REVERSE, offers: int = OFFERS, block: int = BLOCK, quiet: float = 0.05, rounds: int = 12, plain: int = PLAIN
) -> DataFrame:
    """``node``, ``links`` of ``nodes`` (node, vec): the nearest by angle, at most ``reverse`` of the nodes that list it, and the ``plain`` best by inner product.

    Rounds end when less than ``quiet`` of all list entries are new, or after ``rounds``.
    """
    codes = stored(nodes.mapInArrow(_codes, "node long, code binary"), "codes")
    blocks = max(1, -(-codes.count() // block))
    starts = [
        codes.withColumn("block", F.pmod(F.xxhash64("node", F.lit(r)), F.lit(blocks)))
        .groupBy("block").applyInPandas(_block(links // 2, plain), "v long, w long, score double, plain boolean")
        for r in (1, 2)
    ]
    graph = _merged(starts[0].unionByName(starts[1]).withColumn("fresh", F.lit(True)), codes, links, plain, "graph")
    listed = W.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v"))
    for round_ in range(rounds):
        known = _edges(graph)
        forward = known.select(F.col("v").alias("u"), F.col("w").alias("v"), "fresh")
        backward = known.filter("not plain").select(F.col("w").alias("u"), "v", "fresh").withColumn("_r", F.row_number().over(listed))
        met = forward.unionByName(backward.filter(F.col("_r") <= reverse).drop("_r"))
        lows = [
            F.when(F.size(at) >= most, F.element_at(scores, -1)).otherwise(F.lit(float("-inf"))).alias(low)
            for at, scores, most, low in (("links", "scores", links, "low"), ("plain", "plain_scores", plain, "plain_low"))
        ]
        ends = graph.select(F.col("node").alias("v"), *lows, "code")
        brought = met.join(ends, "v").select("u", "v", "fresh", "low", "plain_low", "code").repartition("u").sortWithinPartitions("u")
        offered = brought.mapInArrow(_offers(offers), "v long, w long, score double, plain boolean").withColumn("fresh", F.lit(True))
        graph = _merged(known.withColumn("fresh", F.lit(False)).unionByName(offered), codes, links, plain, f"graph-{round_}")
        changed = [graph.agg(F.avg(F.size(F.filter(fresh, lambda f: f)) / F.size(fresh))).first()[0] for fresh in ("fresh", "plain_fresh")]
        if all(c is None or c < quiet for c in changed):
            break
    forward = _edges(graph).select(F.col("v").alias("u"), F.col("w").alias("v"), "plain")
    backward = forward.filter("not plain").select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("u", "v"))))
    both = forward.drop("plain").unionByName(backward.filter(F.col("_r") <= reverse).drop("_r"))
    return stored(both.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("links")), "links")


def _shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(np.asarray(ids, np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _sharded(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch.column(0).to_numpy(), shards)
            yield pa.record_batch([pa.array(shard), batch.column(0), batch.column(1)], names=["shard", "node", "vec"])

    return run


def _asks(shards: int):
    """What each query asks of each shard: rows (shard, q, vec, nodes) of rows (q, vec, seen, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("q", pa.int64()), ("vec", pa.list_(pa.float64())), ("nodes", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                new = np.setdiff1d(np.array(row["found"], np.int64), np.array(row["seen"], np.int64))
                shard = _shard(new, shards)
                order = np.argsort(shard, kind="stable")
                names, at = np.unique(shard[order], return_index=True)
                rows += [{"shard": s, "q": row["q"], "vec": row["vec"], "nodes": part} for s, part in zip(names.tolist(), np.split(new[order], at[1:]))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _answers(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """Inner products, in double precision, of each query with the nodes it asks for."""
    if not len(vectors) or not len(asks):
        return pd.DataFrame({"q": pd.Series([], dtype="int64"), "nodes": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})
    vectors = vectors.sort_values("node")
    ids, x = vectors["node"].to_numpy(), np.stack(vectors["vec"].to_numpy())
    scores = [(x[np.searchsorted(ids, nodes)] * vec).sum(axis=1) for nodes, vec in zip(asks["nodes"], asks["vec"])]
    return pd.DataFrame({"q": asks["q"], "nodes": asks["nodes"], "scores": scores})


def _steps(beam: int, step: int):
    """The next state (q, vec, seen, nodes, scores, done, todo) of rows (that state, new nodes and scores)."""
    schema = pa.schema(
        [("q", pa.int64()), ("vec", pa.list_(pa.float64())), ("seen", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())),
         ("done", pa.list_(pa.int64())), ("todo", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                done = np.union1d(np.array(row["done"], np.int64), np.array(row["todo"], np.int64))
                new = np.array(row["new_nodes"] or [], np.int64)
                nodes = np.append(np.array(row["nodes"], np.int64), new)
                scores = np.append(np.array(row["scores"], float), np.array(row["new_scores"] or [], float))
                order = np.lexsort((nodes, -scores))[:beam]
                nodes, scores = nodes[order], scores[order]
                rows.append(
                    {"q": row["q"], "vec": row["vec"], "seen": np.append(np.array(row["seen"], np.int64), new), "nodes": nodes, "scores": scores,
                     "done": done, "todo": nodes[~np.isin(nodes, done)][:step]}
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, step: int = STEP, shard: int = SHARD) -> DataFrame:
    """``q``, ``nodes``, ``scores``: the best nodes met, nearest first, for ``queries`` (q, vec, starts: nodes to begin at).

    ``nodes`` has node and vec, ``graph`` node and links. The starts themselves are not among the results unless a link
    leads back to them.
    """
    shards = max(1, -(-nodes.count() // shard))
    vectors = stored(nodes.select("node", "vec").mapInArrow(_sharded(shards), "shard int, node long, vec array<double>"), "shards")
    none, nothing = F.array().cast("array<long>"), F.array().cast("array<double>")
    fields = "q long, vec array<double>, seen array<long>, nodes array<long>, scores array<double>, done array<long>, todo array<long>"
    state = stored(
        queries.select("q", "vec", F.col("starts").alias("seen"), none.alias("nodes"), nothing.alias("scores"), none.alias("done"), F.col("starts").alias("todo")), "search"
    )
    while not state.filter(F.size("todo") > 0).isEmpty():
        ahead = state.select("q", F.explode("todo").alias("node")).join(graph, "node").groupBy("q").agg(F.flatten(F.collect_list("links")).alias("found"))
        asks = state.select("q", "vec", "seen").join(ahead, "q").select("q", "vec", "seen", "found")
        asks = asks.mapInArrow(_asks(shards), "shard int, q long, vec array<double>, nodes array<long>")
        answers = vectors.groupBy("shard").cogroup(asks.groupBy("shard")).applyInPandas(_answers, "q long, nodes array<long>, scores array<double>")
        answers = answers.groupBy("q").agg(F.collect_list(F.struct("nodes", "scores")).alias("a"))
        answers = answers.select("q", F.flatten("a.nodes").alias("new_nodes"), F.flatten("a.scores").alias("new_scores"))
        state = stored(state.join(answers, "q", "left").mapInArrow(_steps(beam, step), fields), "search")
    return state.select("q", "nodes", "scores")


def nearest(
    vectors: DataFrame,
    is_query: str,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    beam: int = BEAM,
    links: int = LINKS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` of the ``k`` nearest found of each query, nearest first.

    Queries are the vectors whose ``id`` satisfies the SQL condition ``is_query``; candidates are all others. Nearness
    is the inner product in double precision; ties go to the smaller id. Vectors that are null, zero, of another
    dimension than most, or hold null or non-finite components take no part, nor do rows without an id. Equal vectors
    are found together. A query with fewer than ``k`` candidates gets all that were found.
    """
    rows = stored(usable(vectors, id_col, vec_col).withColumn("key", wide_hash(F.col("vec"))), "vectors")
    firsts = rows.groupBy("key").agg(F.min("id").alias("node"))
    placed = stored(rows.join(firsts, "key").select("id", "node", F.when(F.col("id") == F.col("node"), F.col("vec")).alias("vec")), "members")
    nodes = placed.filter("vec is not null").select("node", "vec")
    asking = placed.filter(is_query).select(F.col("id").alias("query_id"), "node")
    graph = build_graph(nodes, links=links)
    asked = nodes.join(asking.select("node").distinct(), "node").select(F.col("node").alias("q"), "vec", F.array("node").alias("starts"))
    found = search_graph(nodes, graph, asked, beam)
    own = asked.select("q", F.col("q").alias("node"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("score"))
    met = found.select("q", F.explode(F.slice(F.arrays_zip("nodes", "scores"), 1, k)).alias("e")).select("q", F.col("e.nodes").alias("node"), F.col("e.scores").alias("score"))
    met = met.filter("q <> node").unionByName(own)
    first = W.partitionBy("node").orderBy("id")
    members = placed.select("node", "id").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).drop("_r")
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    listed = met.join(members, "node").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))
    out = asking.join(lists, asking["node"] == lists["q"]).select(
        "query_id", F.posexplode(F.slice(F.filter("all", lambda e: e["id"] != F.col("query_id")), 1, k)).alias("at", "e")
    )
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias(id_col), (-F.col("e.s")).alias("score"))
