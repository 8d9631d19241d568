"""Boosted trees for many training sets at once: one pass a level serves all runs (folds, methods, lists)."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.lineage import ensure_checkpoint_dir

#: Rows that are worth a task, the most rows of one, and about the bytes of histograms that a pass may hold.
BLOCK_ROWS, TASK_ROWS = 60_000, 4_000_000
HISTOGRAM_BYTES = 64 << 20


@dataclass(frozen=True)
class Plan:
    """Trees of each run, their depth, the step, bins of a feature, ridge of leaf values and least curvature of a child."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    bins: int = 64
    ridge: float = 1.0
    least: float = 1.0
    checkpoint: int = 10


@dataclass
class Block:
    """Training rows of some runs: their bins (a row a feature), labels, weights and the sum of all trees so far.

    ``run`` and ``weight`` have a single number if it is that of all rows.
    """

    run: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    bins: np.ndarray
    margin: np.ndarray


@dataclass
class Trees:
    """One tree of every run, as heaps: node 1 is the root, the children of i are 2i and 2i + 1; feature -1 ends a path.

    A row goes left if its bin is at most ``cut``.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, runs: int, depth: int) -> Trees:
        shape = (runs, 2 << depth)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape))

    def nodes(self, run: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches within so many steps; ``bins`` has a row a feature."""
        n = bins.shape[1]
        if len(run) == 1 and depth <= 6:
            return self._narrow(self.feature[run[0]], self.cut[run[0]], bins, depth)
        feature, cut, flat = self.feature.ravel(), self.cut.ravel(), bins.ravel()
        base, place = run.astype(np.int64) * self.feature.shape[1], np.arange(n)
        node = np.ones(n, np.int64)
        for _ in range(depth):
            at = base + node
            by = feature.take(at)
            right = flat.take(np.maximum(by, 0) * np.int64(n) + place) > cut.take(at)
            node = np.where(by < 0, node, 2 * node + right)
        return node


    @staticmethod
    def _narrow(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
        """The same for rows of one run and few nodes: each node of a depth is compared with all rows, byte by byte."""
        node = np.ones(bins.shape[1], np.uint8)
        for d in range(depth):
            right, goes_on = np.zeros(len(node), bool), node >= (1 << d)
            for i in range(1 << d, 2 << d):
                if feature[i] >= 0:
                    right |= (node == i) & (bins[feature[i]] > cut[i])
                else:
                    goes_on &= node != i
            node = np.where(goes_on, 2 * node + right, node)
        return node


class Forest:
    """Fitted trees of all runs with the bin edges of the features."""

    def __init__(self, edges: list[np.ndarray], trees: list[Trees], depth: int):
        self.edges, self.trees, self.depth = edges, trees, depth

    def probability(self, run: np.ndarray, features: np.ndarray) -> np.ndarray:
        bins = to_bins(self.edges, features)
        margin, which = np.zeros(len(run)), _short(run)
        for t in self.trees:
            margin += t.value[which, t.nodes(which, bins, self.depth)]
        return 1 / (1 + np.exp(-margin))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (run, features, other columns) without features, with ``raw``, the probability of label 1."""
        keep = [c for c in rows.columns if c != "features"]
        fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
        shared = rows.sparkSession.sparkContext.broadcast(self)  # runs x trees x 2^(depth + 1) nodes, whatever the rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = shared.value
            for batch in batches:
                which = batch.column(keep.index("run")).to_numpy(zero_copy_only=False)
                flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
                raw = forest.probability(which, flat.reshape(len(which), -1)) if len(which) else np.zeros(0)
                yield pa.record_batch([*[batch.column(i) for i in range(len(keep))], pa.array(raw)], [*keep, "raw"])

        return rows.select(*keep, "features").mapInArrow(run, ", ".join([*fields, "raw double"]))


def to_bins(edges: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """The number of edges below each value, a row a feature."""
    out = np.empty(features.shape[::-1], np.uint8)
    for f, e in enumerate(edges):
        out[f] = np.searchsorted(e, features[:, f], "left")
    return out


def bin_edges(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 different quantiles of every feature over all rows, in one aggregation."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col("features")[f], shares, 10_000).alias(f"q{f}") for f in range(n_features)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, y, weight = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            bins = to_bins(edges, flat.reshape(len(which), -1))
            parts = (which.astype(np.int32), y.astype(float), weight.astype(float), bins)
            yield pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], ["run", "y", "weight", "bins"])

    return rows.select("run", "y", "weight", "features").mapInArrow(run, "run binary, y binary, weight binary, bins binary")


def _short(values: np.ndarray) -> np.ndarray:
    """A single number if all are equal."""
    return values[:1] if (values == values[0]).all() else values


def _slopes(block: Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, weight = 1 / (1 + np.exp(-block.margin[rows])), block.weight if len(block.weight) == 1 else block.weight[rows]
    return (p - block.y[rows]) * weight, np.maximum(p * (1 - p), 1e-16) * weight


def _histogram(block: Block, trees: Trees, depth: int, bins: int, first: int, last: int) -> tuple[int, np.ndarray]:
    """The least run of the block, and from there on sums of slope and curvature by (feature, run, node of this depth,
    bin); below the root of left children only."""
    n_nodes, low = max(1, (1 << depth) >> 1), int(block.run.min())
    node = trees.nodes(block.run, block.bins, depth)
    rows = np.flatnonzero((node >= (1 << depth)) & ((node % 2 == 0) | (depth == 0)))
    run = block.run.astype(np.int64) - low
    place = (node[rows].astype(np.int64) - (1 << depth)) // (2 if depth else 1)
    base = ((run if len(run) == 1 else run[rows]) * n_nodes + place) * bins
    g, h = _slopes(block, rows)
    runs = int(run.max()) + 1
    out = np.empty((2, last - first, runs * n_nodes * bins))
    for f in range(first, last):
        at = base + block.bins[f].take(rows)
        out[0, f - first] = np.bincount(at, g, out.shape[2])
        out[1, f - first] = np.bincount(at, h, out.shape[2])
    return low, out.reshape(2, last - first, runs, n_nodes, bins)


_settled: list[bool] = []


def _settle() -> None:
    """Once a process: takes the loaded modules out of the garbage collection that a worker runs after each of its tasks,
    which costs a short pass more than its sums."""
    if not _settled:
        gc.collect()
        gc.freeze()
        _settled.append(True)


def _sums(blocks: Iterator[Block], trees: Trees, depth: int, bins: int, first: int, last: int) -> Iterator[dict[int, np.ndarray]]:
    """The histograms of a task's blocks by run, added up; only the runs that it has rows of."""
    _settle()
    sums: dict[int, np.ndarray] = {}
    for block in blocks:
        low, found = _histogram(block, trees, depth, bins, first, last)
        for i in range(found.shape[2]):
            if low + i in sums:
                sums[low + i] += found[:, :, i]
            else:
                sums[low + i] = found[:, :, i].copy()
    yield sums


def _together(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return a | {run: a[run] + x if run in a else x for run, x in b.items()}


def _best(full: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each (run, node) from its sums (2, features, runs, nodes, bins), and the values of
    its two children."""
    left = np.cumsum(full, axis=4)[..., :-1]
    total = full[:, 0].sum(-1)  # any feature has all rows of a node
    right = total[:, None, ..., None] - left
    (gl, hl), (gr, hr), (g, h) = left, right, total
    gain = gl**2 / (hl + plan.ridge) + gr**2 / (hr + plan.ridge) - (g**2 / (h + plan.ridge))[None, ..., None]
    gain = np.where((hl >= plan.least) & (hr >= plan.least), gain, -np.inf)
    n_features, runs, nodes, cuts = gain.shape
    side = lambda x: np.moveaxis(x, 0, 2).reshape(runs, nodes, n_features * cuts)
    flat = side(gain)
    pick = flat.argmax(2)[..., None]
    chosen = lambda x: np.take_along_axis(side(x), pick, 2)[..., 0]
    children = np.stack([-plan.rate * chosen(a) / (chosen(b) + plan.ridge) for a, b in ((gl, hl), (gr, hr))], axis=-1)
    good, place = chosen(gain) > 1e-6, pick[..., 0]
    return np.where(good, place // cuts, -1), place % cuts, children


def fit(rows: DataFrame, runs: int, n_features: int, plan: Plan = Plan()) -> Forest:
    """Second-order boosting of the logistic loss for every run of ``rows`` (run, y, weight, features: array of double).

    Features are binned once. A level of one tree of all runs takes one pass, so passes are trees times depth, however
    many runs there are; only left children are summed, their siblings are the difference to the parent. The driver gets
    sums by (run, node, feature, bin), whose number does not depend on the rows. The rows' margins are kept in memory
    (or on disk) and written to the checkpoint folder every few trees, so a lost executor repeats only those. Rows lie
    by run, in about as many tasks as there are cores: a task adds up its blocks and hands on the runs that it holds.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    edges = bin_edges(rows, n_features, plan.bins)
    n = rows.count()
    tasks = max(1, min(-(-n // BLOCK_ROWS), max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))))
    placed = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(tasks, "run", "__place")

    def unpack(r: tuple) -> Block:
        run, y, weight = np.frombuffer(r[0], np.int32), np.frombuffer(r[1]), np.frombuffer(r[2])
        bins, whole = np.frombuffer(r[3], np.uint8).reshape(-1, len(run)), ((y == 0) | (y == 1)).all()
        return Block(_short(run), y.astype(np.uint8) if whole else y, _short(weight), bins, np.zeros(len(y)))

    state = _blocks(placed.sortWithinPartitions("run"), edges).rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    made: list[Trees] = []
    old: list = []
    for t in range(plan.trees):
        trees = Trees.empty(runs, plan.depth)
        above = None
        for depth in range(plan.depth):
            begin, n_nodes = 1 << depth, max(1, (1 << depth) >> 1)
            step = max(1, HISTOGRAM_BYTES // (16 * runs * n_nodes * plan.bins))
            mine = np.zeros((2, n_features, runs, n_nodes, plan.bins))
            for a in range(0, n_features, step):
                b = min(n_features, a + step)
                sums = state.mapPartitions(lambda x, a=a, b=b: _sums(x, trees, depth, plan.bins, a, b))
                for run, found in sums.treeReduce(_together, depth=1 if tasks <= 64 else 2).items():
                    mine[:, a:b, run] = found
            while old:
                old.pop().unpersist()
            if above is None:
                g, h = mine[:, 0].sum(-1)
                trees.value[:, 1:2] = -plan.rate * g / (h + plan.ridge)
            else:
                both = np.empty((*above.shape[:3], 2 * above.shape[3], plan.bins))
                both[:, :, :, ::2], both[:, :, :, 1::2] = mine, above - mine
                mine = both
            feature, cut, children = _best(mine, plan)
            trees.feature[:, begin : 2 * begin], trees.cut[:, begin : 2 * begin] = feature, cut
            trees.value[:, 2 * begin : 4 * begin] = children.reshape(runs, -1)
            above = mine
            if (feature < 0).all():
                break
        made.append(trees)

        def grown(x: Block, trees: Trees = trees) -> Block:
            return Block(x.run, x.y, x.weight, x.bins, x.margin + trees.value[x.run, trees.nodes(x.run, x.bins, plan.depth)])

        old.append(state)
        state = state.map(grown).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % plan.checkpoint == 0:
            state.checkpoint()
    state.unpersist()
    for x in old:
        x.unpersist()
    return Forest(edges, made, plan.depth)
