"""Boosted trees that grow best leaf first, from histograms added up by Spark.

Features are binned once. For every open leaf, Spark adds up gradients per (leaf, feature, bin) and picks each leaf's best
split; one row for each leaf reaches the driver. A tree always splits the leaf with the largest gain next. To learn the gains
of children without a job for every split, all open leaves that may still be split are split on trial and their children
measured in one job; the order of splits is then replayed from what is known. So a tree takes about as many jobs as it is
deep. Gradients are whole numbers, so that sums, and with them the trees, do not depend on the order of rows.

The result is a Spark ML ensemble: it predicts, is saved and is read like any other.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import scratch_path
from riskloom.sources.files import remove

BINS = "_bins"
#: The largest gradient counts as so many units; sums of 8e12 rows still fit a 64-bit number.
UNITS = 1 << 20
#: Leaves of trees that are added to a stored prediction as an expression before it is stored anew.
OPEN_LEAVES = 64


@dataclass(frozen=True)
class Sums:
    """Number of rows, gradient and curvature of the rows of a node."""

    n: int
    gradient: int
    curvature: int


@dataclass
class Node:
    """A node of a tree in growth; ``gain`` is unknown (None) until its best split has been looked for."""

    number: int
    depth: int
    sums: Sums | None = None
    gain: float | None = None
    feature: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None
    #: Sums of the two sides of the best split.
    sides: tuple[Sums, Sums] | None = None


def bin_edges(rows: DataFrame, vector: str, max_bins: int) -> list[list[float]]:
    """Upper edges of at most ``max_bins`` bins of each feature: values that are its quantiles; only sketches reach the driver."""
    first = rows.select(F.size(vector_to_array(vector))).first()
    if first is None:
        return []
    names = [f"_v{i}" for i in range(first[0])]
    values = vector_to_array(vector)
    wide = rows.select(*[values[i].alias(n) for i, n in enumerate(names)])
    shares = [i / max_bins for i in range(1, max_bins)]
    found = wide.approxQuantile(names, [0.0, *shares, 1.0], 1.0 / (8 * max_bins))
    # Nothing lies above the largest value, so it is no edge.
    return [sorted({e for e in own if e == e and e < max(own)}) if own else [] for own in found]


def with_bins(rows: DataFrame, vector: str, edges: Sequence[Sequence[float]]) -> DataFrame:
    """``rows`` with ``_bins``: of each feature, how many edges lie below its value."""
    values = vector_to_array(vector)
    wide, names = rows, []
    for i, own in enumerate(edges):
        wide = wide.withColumn(f"_v{i}", values[i])
        if own:
            splits = [-math.inf, *(float(np.nextafter(e, math.inf)) for e in own), math.inf]
            wide = Bucketizer(inputCol=f"_v{i}", outputCol=f"_b{i}", splits=splits, handleInvalid="keep").transform(wide)
        names.append(F.col(f"_b{i}").cast("short") if own else F.lit(0).cast("short"))
    return wide.withColumn(BINS, F.array(*names)).drop(*[f"_{k}{i}" for k in "vb" for i in range(len(edges))])


def _select(root: Node, at_leaf) -> Column | None:
    """An expression that finds a row's leaf by its bins; ``None`` where ``at_leaf`` has nothing for any leaf below."""
    if root.left is None:
        return at_leaf(root)
    left, right = _select(root.left, at_leaf), _select(root.right, at_leaf)
    if left is None and right is None:
        return None
    goes_left = F.col(BINS)[root.feature] <= F.lit(root.cut)
    return F.when(goes_left, F.lit(None) if left is None else left).otherwise(F.lit(None) if right is None else right)


def histograms(rows: DataFrame, leaf: Column, features: Sequence[int]) -> DataFrame:
    """``n``, ``g`` and ``h`` by (leaf, feature, bin) of rows with ``_g`` and ``_h``; rows without a leaf are left out."""
    exploded = rows.select(leaf.alias("leaf"), "_g", "_h", BINS).where("leaf is not null").select(
        "leaf", "_g", "_h", F.posexplode(BINS).alias("feature", "bin")
    )
    chosen = exploded.where(F.col("feature").isin(list(features)))
    return chosen.groupBy("leaf", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_g").alias("g"), F.sum("_h").alias("h"))


def best_splits(table: DataFrame, min_instances: int) -> DataFrame:
    """Per leaf its totals and, where any split leaves enough rows on both sides and gains, the best one.

    Of equal gains the smaller feature wins, then the smaller bin. A window holds the bins of one feature of one leaf.
    """
    upto = Window.partitionBy("leaf", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("leaf", "feature")
    sums = table.select(
        "leaf", "feature", "bin",
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in "ngh"],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in "ngh"],
    )
    left, total = F.struct("n_left", "g_left", "h_left"), F.struct("n_all", "g_all", "h_all")
    right_h = F.col("h_all") - F.col("h_left")

    def worth(g: Column, h: Column) -> Column:
        return F.try_divide(g.cast("double") * g.cast("double"), h.cast("double"))

    gain = worth(F.col("g_left"), F.col("h_left")) + worth(F.col("g_all") - F.col("g_left"), right_h) - worth(F.col("g_all"), F.col("h_all"))
    enough = (F.col("n_left") >= min_instances) & (F.col("n_all") - F.col("n_left") >= min_instances) & (F.col("h_left") > 0) & (right_h > 0)
    order = F.struct(F.when(gain > 0, gain).alias("gain"), -F.col("feature"), -F.col("bin"))
    return sums.withColumn("_order", F.when(enough, order)).groupBy("leaf").agg(
        F.any_value(total).alias("total"), F.max_by(F.struct("feature", "bin", left.alias("left"), F.col("_order.gain").alias("gain")), "_order").alias("best")
    )


def grow_tree(rows: DataFrame, features: Sequence[int], *, leaves: int, depth: int, min_instances: int) -> tuple[Node, int]:
    """A tree of at most ``leaves`` leaves over rows with ``_bins``, ``_g`` and ``_h``; and the number of jobs it took."""
    root, numbers, jobs = Node(0, 0), 1, 0
    unknown = [root]
    while True:
        wanted = {u.number for u in unknown}
        leaf = _select(root, lambda node: F.lit(node.number) if node.number in wanted else None)
        found = {r["leaf"]: r for r in best_splits(histograms(rows, leaf, features), min_instances).collect()}
        jobs += 1
        for node in unknown:
            row = found.get(node.number)
            if row is None:
                node.sums, node.gain = node.sums or Sums(0, 0, 0), 0.0
                continue
            node.sums, best = Sums(*row["total"]), row["best"]
            node.gain = best["gain"] if best is not None and best["gain"] is not None and node.depth < depth else 0.0
            if node.gain:
                node.feature, node.cut = best["feature"], best["bin"]
                left = Sums(*best["left"])
                node.sides = left, Sums(node.sums.n - left.n, node.sums.gradient - left.gradient, node.sums.curvature - left.curvature)
        taken, missing = _replay(root, leaves)
        if not missing:
            return _pruned(root, taken), jobs
        # Split on trial every leaf that may still be chosen; their children are measured together. What lies in a child is
        # known from its parent's split, so children as deep as may be are not measured.
        unknown = []
        while missing and not unknown:
            for node in missing:
                node.left, node.right = Node(numbers, node.depth + 1, node.sides[0]), Node(numbers + 1, node.depth + 1, node.sides[1])
                numbers += 2
                for child in (node.left, node.right):
                    if child.depth < depth:
                        unknown.append(child)
                    else:
                        child.gain = 0.0
            if not unknown:
                taken, missing = _replay(root, leaves)
        if not unknown:
            return _pruned(root, taken), jobs


def _replay(root: Node, leaves: int) -> tuple[set[int], list[Node]]:
    """Nodes split in best-first order as far as gains are known, and the nodes whose children have to be measured next.

    While children are unknown no later choice is certain; then the open nodes with the largest gains, as many as there
    may still be splits, are named.
    """
    queue = [(-root.gain, root.number, root)] if root.gain else []
    taken: set[int] = set()
    while queue and len(taken) < leaves - 1:
        _, number, node = heapq.heappop(queue)
        if node.left is None:
            if len(taken) == leaves - 2:  # the last split: nothing below it will be split
                taken.add(number)
                break
            rest = leaves - 1 - len(taken)
            open_nodes = [node, *(n for _, _, n in sorted(queue)[: rest - 1])]
            return taken, [n for n in open_nodes if n.left is None]
        taken.add(number)
        for child in (node.left, node.right):
            if child.gain:
                heapq.heappush(queue, (-child.gain, child.number, child))
    return taken, []


def _pruned(root: Node, taken: set[int]) -> Node:
    """The tree of the splits taken; a last split without measured children gets them with the sums of its sides."""
    if root.number not in taken:
        root.left = root.right = None
        return root
    if root.left is None:
        root.left, root.right = (Node(-2 * root.number - k, root.depth + 1, side) for k, side in zip((1, 2), root.sides))
    root.left, root.right = _pruned(root.left, taken), _pruned(root.right, taken)
    return root


def _leaves(root: Node) -> list[Node]:
    return [root] if root.left is None else _leaves(root.left) + _leaves(root.right)


def _value(node: Node) -> float:
    return node.sums.gradient / node.sums.curvature if node.sums.curvature else 0.0


class _Ensemble:
    """Builds the Spark ML model from nodes."""

    def __init__(self, spark: SparkSession, edges: Sequence[Sequence[float]], unit: float, halved: float):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.edges, self.unit, self.halved = edges, unit, halved

    def _doubles(self, values: Sequence[float]):
        out = self.gateway.new_array(self.jvm.double, len(values))
        for i, value in enumerate(values):
            out[i] = float(value)
        return out

    def _stats(self, n: int, mean: float):
        calculator = self.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
        return calculator(self._doubles([n, n * mean, n * mean * mean]), n)

    def _node(self, node: Node):
        tree, value = self.jvm.org.apache.spark.ml.tree, _value(node) * self.unit * self.halved
        if node.left is None:
            return tree.LeafNode(value, 0.0, self._stats(node.sums.n, value))
        own = self.edges[node.feature]
        # Beyond the last edge only NaN goes right.
        split = tree.ContinuousSplit(node.feature, float(own[node.cut]) if node.cut < len(own) else math.inf)
        gain = node.gain * self.unit**2 / UNITS / max(node.sums.n, 1)
        return tree.InternalNode(value, 0.0, gain, self._node(node.left), self._node(node.right), split, self._stats(node.sums.n, value))

    def constant(self, value: float, n: int):
        return self.jvm.org.apache.spark.ml.tree.LeafNode(value, 0.0, self._stats(n, value))

    def model(self, roots: list, weights: Sequence[float], task: str, vector: str, label: str):
        ml = self.jvm.org.apache.spark.ml
        kind = ml.regression.DecisionTreeRegressionModel
        trees = self.gateway.new_array(kind, len(roots))
        for i, root in enumerate(roots):
            trees[i] = kind(f"tree_{i}", root, len(self.edges)).setFeaturesCol(vector)
        if task == "regression":
            made = GBTRegressionModel(ml.regression.GBTRegressionModel("leafwise", trees, self._doubles(weights)))
        else:
            made = GBTClassificationModel(ml.classification.GBTClassificationModel("leafwise", trees, self._doubles(weights), len(self.edges), 2))
        made._set(featuresCol=vector, labelCol=label)._transfer_params_to_java()
        return made


def _gradients(state: DataFrame, task: str, scale: float) -> DataFrame:
    """Rows with ``_g`` and ``_h`` in whole units at the present prediction ``_f``."""
    if task == "regression":
        return state.withColumn("_g", F.round((F.col("_y") - F.col("_f")) * scale).cast("long")).withColumn("_h", F.lit(UNITS).cast("long"))
    p = 1 / (1 + F.exp(-F.col("_f")))
    return state.withColumn("_g", F.round((F.col("_y") - p) * UNITS).cast("long")).withColumn("_h", F.round(p * (1 - p) * UNITS).cast("long"))


def _loss(task: str) -> Column:
    y, f = F.col("_y"), F.col("_f")
    if task == "regression":
        return F.avg((y - f) * (y - f))
    return F.avg(F.log1p(F.exp(-F.abs(f))) + F.greatest(f, F.lit(0.0)) - y * f)


def fit_leafwise(
    train: DataFrame,
    valid: DataFrame | None,
    edges: Sequence[Sequence[float]],
    *,
    target: str,
    vector: str,
    task: str = "regression",
    rounds: int,
    leaves: int,
    depth: int,
    min_instances: int,
    step_size: float,
    subsampling: float,
    feature_share: float,
    patience: int,
    seed: int,
):
    """A boosted ensemble over rows with ``_bins``; the trees after the best round on ``valid`` are left away.

    ``train`` must hold two different targets; a target of classification is 0 or 1. Each tree sees a share of the rows,
    drawn by hash of a stored row number, and a share of the features. Boosting ends when ``patience`` rounds bring no
    gain.
    """
    parts = [train.select(F.col(target).cast("double").alias("_y"), BINS, F.lit(True).alias("_fits"))]
    if valid is not None:
        parts.append(valid.select(F.col(target).cast("double").alias("_y"), BINS, F.lit(False).alias("_fits")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    stored = _Stored(train.sparkSession, len(edges))
    try:
        return _boosted(
            stored, rows.withColumn("_row", F.monotonically_increasing_id()), edges, target=target, vector=vector, task=task, rounds=rounds, leaves=leaves,
            depth=depth, min_instances=min_instances, step_size=step_size, subsampling=subsampling, feature_share=feature_share, patience=patience, seed=seed,
        )
    finally:
        stored.clear()


class _Stored:
    """Rows of one fit as Parquet files, a column for each feature's bins, so that reading them again costs little.

    Nothing else reads the files, so each version goes with the next one.
    """

    def __init__(self, spark: SparkSession, features: int):
        self.spark, self.path, self.bins = spark, None, [f"_bin{i}" for i in range(features)]

    def put(self, rows: DataFrame) -> DataFrame:
        old, path = self.path, scratch_path(self.spark, "fit")
        rest = [c for c in rows.columns if c != BINS]
        wide = rows.select(*rest, *[F.col(BINS)[i].alias(name) for i, name in enumerate(self.bins)])
        wide.write.parquet(path)
        self.path = path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(wide.schema).parquet(path).select(*rest, F.array(*self.bins).alias(BINS))

    def clear(self) -> None:
        if self.path:
            remove(self.spark, self.path)


def _boosted(
    stored: _Stored,
    rows: DataFrame,
    edges: Sequence[Sequence[float]],
    *,
    target: str,
    vector: str,
    task: str,
    rounds: int,
    leaves: int,
    depth: int,
    min_instances: int,
    step_size: float,
    subsampling: float,
    feature_share: float,
    patience: int,
    seed: int,
):
    state = stored.put(rows)
    fits = F.col("_fits")
    mean, low, high, n = state.where(fits).agg(F.avg("_y"), F.min("_y"), F.max("_y"), F.count(F.lit(1))).first()
    base = mean if task == "regression" else math.log(mean / (1 - mean))
    widest = max(high - low, 1e-300)
    scale = UNITS / widest if task == "regression" else UNITS
    # What a leaf's quotient of whole numbers has to be multiplied by to be a step of the prediction.
    unit = widest if task == "regression" else 1.0
    halved = 1.0 if task == "regression" else 0.5  # Spark's classifier doubles the margin
    build = _Ensemble(stored.spark, edges, unit, halved)
    state = state.withColumn("_f", F.lit(float(base)))
    roots, errors, open_leaves = [build.constant(base * halved, n)], [], 0
    best, generator = 0, random.Random(seed)
    errors.append(state.where(~fits).agg(_loss(task)).first()[0])
    for round_number in range(1, rounds + 1):
        count = max(1, round(feature_share * len(edges)))
        features = sorted(generator.sample(range(len(edges)), count))
        drawn = F.pmod(F.xxhash64("_row", F.lit(seed), F.lit(round_number)), F.lit(1_000_000)) < int(subsampling * 1_000_000)
        sampled = _gradients(state.where(fits & drawn) if subsampling < 1 else state.where(fits), task, scale)
        root, _ = grow_tree(sampled, features, leaves=leaves, depth=depth, min_instances=min_instances)
        if root.left is None:
            if subsampling >= 1 and count == len(edges):
                break  # nothing can be gained any more
            continue
        step = _select(root, lambda node: F.lit(_value(node) * unit * step_size))
        # The prediction is worked out from the trees since it was stored; long expressions are cut off by storing it.
        state, open_leaves = state.withColumn("_f", F.col("_f") + step), open_leaves + len(_leaves(root))
        if open_leaves >= OPEN_LEAVES:
            state, open_leaves = stored.put(state), 0
        roots.append(build._node(root))
        if errors[0] is not None:
            errors.append(state.where(~fits).agg(_loss(task)).first()[0])
            if errors[-1] < errors[best]:
                best = len(errors) - 1
            elif len(errors) - 1 - best >= patience:
                break
    if errors[0] is not None:
        roots = roots[: max(best, min(1, len(roots) - 1)) + 1]
    return build.model(roots, [1.0] + [step_size] * (len(roots) - 1), task, vector, target)
