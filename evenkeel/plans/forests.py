"""Random forests for many training sets at once: one pass a level serves all trees of all runs (folds, methods, lists)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.plans.boosting import to_bins

#: Rows that are worth a task, the most rows of one, and those whose numbers stay in a core's cache.
BLOCK_ROWS, TASK_ROWS, PIECE_ROWS = 20_000, 2_000_000, 1 << 15
#: About the bytes of states, two for each row and tree, that there may be for each core: trees beyond them grow afterwards.
STATE_BYTES = 256 << 20
#: About the bytes of sums of a run that a pass may make.
HISTOGRAM_BYTES = 256 << 20
#: Weights are rounded to this fraction, so that sums do not depend on the order of the blocks.
GRAIN = 1 << 24
#: Chances of a row to come at most 0, 1, ... 14 times into the bag of a tree: Poisson with mean one.
BAG = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(15)])
#: The same as the least draws of 53 bits that lie beyond; the times by the first 12 bits of a draw, and where these do not tell.
BEYOND = np.ceil(BAG * 2.0**53).astype(np.uint64)
FIRST_BITS = np.arange(1 << 12, dtype=np.uint64) << np.uint64(41)
TIMES = np.searchsorted(BEYOND, FIRST_BITS, "right").astype(np.uint16)
UNSURE = TIMES != np.searchsorted(BEYOND, FIRST_BITS + np.uint64((1 << 41) - 1), "right")


@dataclass(frozen=True)
class Plan:
    """Trees of each run, their depth (at most 12), bins of a feature (at most 128) and the seed of bags and features."""

    trees: int = 100
    depth: int = 12
    bins: int = 32
    seed: int = 42


@dataclass
class Rows:
    """Training rows of one run: their numbers, weights (a single 1 if all are) and ``2 * bin + label``, a row a feature."""

    run: int
    key: np.ndarray
    weight: np.ndarray
    cells: np.ndarray


@dataclass
class Level:
    """The open nodes of one depth of one tree: the feature (-1: none is better than a leaf) and cut of each, and of its two
    children (of itself where it is a leaf) the share of label 1 and the place among the open nodes of the next depth (-1: a
    leaf). A row goes left if its bin is at most ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray
    place: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row comes into the bag of a tree, drawn by a hash of its number."""
    salt = _mixed(np.array([(seed << 20) + tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty(len(key), np.uint16)
    for a in range(0, len(key), PIECE_ROWS):
        drawn = _mixed(key[a : a + PIECE_ROWS] ^ salt) >> np.uint64(11)
        first = (drawn >> np.uint64(41)).astype(np.int64)
        part = TIMES.take(first)
        odd = np.flatnonzero(UNSURE.take(first))
        part[odd] = np.searchsorted(BEYOND, drawn[odd], "right")
        out[a : a + PIECE_ROWS] = part
    return out


def _choices(seed: int, tree: int, depth: int, nodes: int, n_features: int) -> np.ndarray:
    """Different features for each node, as many as the square root of all."""
    chosen = math.ceil(math.sqrt(n_features))
    drawn = np.random.default_rng([seed, tree, depth]).random((nodes, n_features))
    return np.sort(np.argpartition(drawn, chosen - 1, axis=1)[:, :chosen], axis=1)


def bin_edges(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """The least value and up to ``bins`` - 2 different quantiles of every feature over all rows, in one aggregation."""
    shares = [i / (bins - 1) for i in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col("features")[f], shares, 10_000).alias(f"q{f}") for f in range(n_features)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, y, weight, key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            cells = 2 * to_bins(edges, flat.reshape(len(which), len(edges))) + (y > 0.5).astype(np.uint8)
            for r in np.unique(which):
                mine = which == r
                parts = [key[mine].astype(np.uint64), weight[mine].astype(float), np.ascontiguousarray(cells[:, mine])]
                yield pa.record_batch([pa.array([int(r)], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["run", "key", "weight", "cells"])

    return rows.select("run", "y", "weight", "key", "features").mapInArrow(run, "run int, key binary, weight binary, cells binary")


def _gathered(blocks: Iterator[tuple], n_features: int) -> Iterator[Rows]:
    """The blocks of a task as one for each of its runs."""
    found: dict[int, list[tuple]] = {}
    for run, *parts in blocks:
        found.setdefault(run, []).append(parts)
    for run in sorted(found):
        key, weight, cells = zip(*found.pop(run))
        weights = np.round(np.frombuffer(b"".join(weight)) * GRAIN) / GRAIN
        yield Rows(
            run,
            np.frombuffer(b"".join(key), np.uint64),
            weights[:1] if (weights == 1).all() else weights,
            np.concatenate([np.frombuffer(c, np.uint8).reshape(n_features, -1) for c in cells], axis=1),
        )


def _begun(rows: Rows, plan: Plan, first: int, last: int) -> Iterator[Rows | tuple[int, np.ndarray]]:
    """The rows, then the state of each of some trees: 16 * node + times in the bag, 0 where a row is out or has reached a leaf."""
    yield Rows(rows.run, rows.key[:0], rows.weight, rows.cells)
    for tree in range(first, last):
        yield tree, bags(rows.key, tree, plan.seed)


# Below, ``mode="clip"`` spares the check of places, which are all valid.


def _pieces(state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a state: the first row of each, the rows of it that are not out, and their states."""
    for a in range(0, len(state), PIECE_ROWS):
        piece = state[a : a + PIECE_ROWS]
        active = np.flatnonzero(piece != 0)
        if len(active):
            yield a, active, piece.take(active, mode="clip")


def _moved(states: Iterator[Rows | tuple[int, np.ndarray]], levels: dict[tuple[int, int], Level]) -> Iterator[Rows | tuple[int, np.ndarray]]:
    """The states one level further down; trees that are grown are left out."""
    for x in states:
        if isinstance(x, Rows):
            rows, n, flat = x, x.cells.shape[1], x.cells.ravel()
            yield x
            continue
        tree, state = x
        level = levels.get((rows.run, tree))
        if level is None:
            continue
        begin = np.maximum(level.feature, 0) * np.int64(n)
        last_left = (2 * level.cut + 1).astype(np.uint8)
        goes_on = level.place.ravel() >= 0
        place = np.where(goes_on, 16 * level.place.ravel(), 0).astype(np.uint16)
        bag = np.where(goes_on, 15, 0).astype(np.uint16)
        new = np.zeros_like(state)
        for a, active, was in _pieces(state):
            node = (was >> 4).astype(np.int64)
            at = begin.take(node, mode="clip")
            at += active
            at += a
            right = flat.take(at, mode="clip") > last_left.take(node, mode="clip")
            node *= 2
            node += right
            new[a : a + PIECE_ROWS][active] = place.take(node, mode="clip") | (was & bag.take(node, mode="clip"))
        yield tree, new


def _sums(
    states: Iterator[Rows | tuple[int, np.ndarray]], plan: Plan, features: dict[tuple[int, int], np.ndarray], first: int, last: int
) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """For some trees the weights in the bag by (choice of feature, open node, bin, label); ``features`` has a row a node."""
    width = 2 * plan.bins
    for x in states:
        if isinstance(x, Rows):
            rows, n, flat, plain = x, x.cells.shape[1], x.cells.ravel(), len(x.weight) == 1
            continue
        tree, state = x
        choices = features.get((rows.run, tree))
        if choices is None or not first <= tree < last:
            continue
        begin, out = np.ascontiguousarray(choices.T) * np.int64(n), None
        for a, active, was in _pieces(state):
            node = (was >> 4).astype(np.int64)
            amount = (was & 15).astype(float)
            active += a
            if not plain:
                amount *= rows.weight.take(active, mode="clip")
            if out is None:
                out = np.zeros((choices.shape[1], len(choices) * width))
            base = node * width
            for j in range(len(out)):
                at = begin[j].take(node, mode="clip")
                at += active
                out[j] += np.bincount(base + flat.take(at, mode="clip"), amount, out.shape[1])
        if out is not None:
            out = out.reshape(len(out), len(choices), plan.bins, 2)
            yield (rows.run, tree), _narrow(out) if plain else out


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    return counts.astype(np.min_scalar_type(int(counts.max())))


def _added(sums: Iterator[tuple[tuple[int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    found: dict[tuple[int, int], np.ndarray] = {}
    for key, part in sums:
        if key in found:
            found[key] += part
        else:
            found[key] = part.astype(float)
    while found:
        yield found.popitem()


def _grown(sums: np.ndarray, choices: np.ndarray) -> Level:
    """The best cuts, by the fall of Gini impurity, of the open nodes of a tree."""
    total = sums[0].sum(1)  # (node, label); any feature has all rows of a node
    left = sums.cumsum(2)[:, :, :-1]
    right = total[None, :, None] - left

    def impure(x: np.ndarray) -> np.ndarray:
        """Twice the product of both labels over their sum: the Gini impurity times the rows."""
        both = x.sum(-1)
        return 2 * x[..., 0] * x[..., 1] / np.where(both > 0, both, 1)

    gain = impure(total)[None, :, None] - impure(left) - impure(right)
    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), gain, -np.inf)
    nodes = np.arange(len(total))
    flat = np.moveaxis(gain, 0, 1).reshape(len(nodes), -1)
    best = flat.argmax(1)
    pick, cut = np.divmod(best, gain.shape[2])
    good = flat[nodes, best] > 1e-9 * np.maximum(total.sum(1), 1)
    children = np.stack([left[pick, nodes, cut], right[pick, nodes, cut]], axis=1)  # (node, side, label)
    children = np.where(good[:, None, None], children, total[:, None])
    share = children[..., 1] / np.maximum(children.sum(-1), 1e-300)
    goes_on = good[:, None] & (children > 0).all(-1)
    place = np.where(goes_on, np.cumsum(goes_on.ravel()).reshape(-1, 2) - 1, -1)
    return Level(np.where(good, choices[nodes, pick], -1), cut, share, place)


def _joined(levels: list[Level], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A whole tree, leaves after the open nodes: where the cells of a node's feature begin (of ``n`` rows), its cut, its two
    children and its share. A leaf is its own child."""
    opened = np.cumsum([0, *[len(x.feature) for x in levels]])
    inner = int(opened[-1])
    place = [np.where(x.place >= 0, x.place + below, -1).ravel() for x, below in zip(levels, opened[1:])]
    child = np.concatenate(place)
    leaves = np.flatnonzero(child < 0)
    child[leaves] = inner + np.arange(len(leaves))
    feature, cut = (np.concatenate([getattr(x, k) for x in levels]) for k in ("feature", "cut"))
    share = np.concatenate([x.share.ravel() for x in levels])[leaves]
    pad = np.zeros(len(leaves), np.int64)
    return (
        np.concatenate([np.maximum(feature, 0).astype(np.int64) * n, pad]),
        np.concatenate([cut.astype(np.int64), pad]).astype(np.uint8),
        np.concatenate([child.astype(np.int64), np.repeat(inner + np.arange(len(leaves)), 2)]),
        np.concatenate([np.zeros(inner), share]),
    )


class Forests:
    """Fitted trees of all runs with the bin edges of the features; ``levels`` by (run, tree), the root first."""

    def __init__(self, edges: list[np.ndarray], roots: dict[int, float], levels: dict[tuple[int, int], list[Level]], trees: int):
        self.edges, self.roots, self.levels, self.trees = edges, roots, levels, trees

    def probability(self, run: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The mean over the trees of the share of label 1 in the leaf of a row."""
        bins, out = to_bins(self.edges, features), np.zeros(len(run))
        for r in np.unique(run):
            mine = np.flatnonzero(run == r)
            cells, at, total = np.ascontiguousarray(bins[:, mine]).ravel(), np.arange(len(mine)), np.zeros(len(mine))
            for tree in range(self.trees):
                levels = self.levels.get((int(r), tree), [])
                if not levels:
                    total += self.roots[int(r)]
                    continue
                begin, cut, child, share = _joined(levels, len(mine))
                node = np.zeros(len(mine), np.int64)
                for _ in levels:
                    where = begin.take(node, mode="clip")
                    where += at
                    right = cells.take(where, mode="clip") > cut.take(node, mode="clip")
                    node *= 2
                    node += right
                    node = child.take(node, mode="clip")
                total += share.take(node, mode="clip")
            out[mine] = total / self.trees
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (run, features, other columns) without features, with ``raw``, the probability of label 1."""
        keep = [c for c in rows.columns if c != "features"]
        fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
        shared = rows.sparkSession.sparkContext.broadcast(self)  # at most runs x trees x 2^depth nodes, whatever the rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forests = shared.value
            for batch in batches:
                which = batch.column(keep.index("run")).to_numpy(zero_copy_only=False)
                flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
                raw = forests.probability(which, flat.reshape(len(which), -1)) if len(which) else np.zeros(0)
                yield pa.record_batch([*[batch.column(i) for i in range(len(keep))], pa.array(raw)], [*keep, "raw"])

        return rows.select(*keep, "features").mapInArrow(run, ", ".join([*fields, "raw double"]))


def fit(rows: DataFrame, n_features: int, plan: Plan = Plan()) -> Forests:
    """A random forest for every run of ``rows`` (run, y, weight, features: array of double).

    Features are binned once. All nodes of a depth, of all trees and runs, are grown in one pass: tasks sum their rows by
    (node, chosen feature, bin, label), the sums of a tree are added and searched in one of as many tasks, and the driver
    gets the chosen cuts, whose number does not depend on the rows. Which node of each tree a row is in is kept in memory
    (or on disk), for as many trees at a time as ``STATE_BYTES`` allow. Bags are drawn by a hash of the row's number within its run, features by tree and depth, so neither
    depends on the number of tasks or on the runs beside.
    """
    if not 1 <= plan.depth <= 12 or not 3 <= plan.bins <= 128:
        raise ValueError("depth must be between 1 and 12, bins between 3 and 128")
    spark = rows.sparkSession
    sc, edges = spark.sparkContext, bin_edges(rows, n_features, plan.bins)
    numbered = rows.withColumn("key", F.monotonically_increasing_id())
    part = F.shiftright("key", 33)
    share = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("y")), F.sum("weight")), F.lit(0.0))
    by_run = numbered.groupBy("run").agg(F.min(part).alias("first"), F.count("*").alias("n"), share.alias("share")).collect()
    by_run = {r["run"]: r for r in by_run}
    first = sc.broadcast({r: x["first"] for r, x in by_run.items()})
    n = sum(x["n"] for x in by_run.values())
    tasks = max(1, min(-(-n // BLOCK_ROWS), max(sc.defaultParallelism, -(-n // TASK_ROWS))))
    placed = numbered.repartitionByRange(tasks, "run", "key").sortWithinPartitions("run", "key")

    def begin(blocks: Iterator[tuple]) -> Iterator[Rows]:
        for mine in _gathered(blocks, n_features):
            mine.key = mine.key - np.uint64(first.value[mine.run] << 33)
            yield mine

    base = _blocks(placed, edges).rdd.map(tuple).mapPartitions(begin).persist(StorageLevel.MEMORY_AND_DISK)
    levels: dict[tuple[int, int], list[Level]] = {}
    together = max(1, sc.defaultParallelism * STATE_BYTES // (2 * max(1, n)))
    together = -(-plan.trees // -(-plan.trees // together))  # about equal groups
    for low in range(0, plan.trees, together):
        group = range(low, min(plan.trees, low + together))
        for key, grown in _grow_group(base, list(by_run), group, n_features, plan, tasks).items():
            levels[key] = grown
    base.unpersist()
    return Forests(edges, {r: x["share"] for r, x in by_run.items()}, levels, plan.trees)


def _grow_group(base: RDD, runs: list[int], trees: range, n_features: int, plan: Plan, tasks: int) -> dict[tuple[int, int], list[Level]]:
    """The levels of some trees of all runs, from the rows of all tasks."""
    sc, low, high = base.context, trees.start, trees.stop
    levels: dict[tuple[int, int], list[Level]] = {}
    old: list = []
    choices = {(r, t): _choices(plan.seed, t, 0, 1, n_features) for r in runs for t in trees}
    state = base.flatMap(lambda x: _begun(x, plan, low, high)).persist(StorageLevel.MEMORY_AND_DISK)
    for depth in range(plan.depth):
        shared = sc.broadcast(choices)

        def grow(sums: Iterator[tuple], shared=shared, last=depth == plan.depth - 1) -> Iterator[tuple]:
            for key, found in _added(sums):
                level = _grown(found, shared.value[key])
                if last:
                    level.place = np.full_like(level.place, -1)
                small = Level(level.feature.astype(np.int32), level.cut.astype(np.int16), level.share, level.place.astype(np.int32))
                yield key, small

        most = max(x.size for x in choices.values()) * plan.bins * 16 * -(-len(runs) // tasks)
        step, found = max(1, HISTOGRAM_BYTES // most), {}
        for a in range(low, high, step):
            sums = state.mapPartitions(lambda x, a=a, b=min(high, a + step), shared=shared: _sums(x, plan, shared.value, a, b))
            dealt = sums.partitionBy(tasks, lambda key: key[0] * plan.trees + key[1])
            found |= dict(dealt.mapPartitions(grow).collect())  # cuts of the open nodes
        while old:
            old.pop().unpersist()
        choices = {}
        for key, level in found.items():
            levels.setdefault(key, []).append(level)
            if (opened := int(level.place.max()) + 1) > 0:
                choices[key] = _choices(plan.seed, key[1], depth + 1, opened, n_features)
        if not choices:
            break
        told = sc.broadcast({key: found[key] for key in choices})
        old.append(state)
        state = state.mapPartitions(lambda x, told=told: _moved(x, told.value)).persist(StorageLevel.MEMORY_AND_DISK)
    for x in (*old, state):
        x.unpersist()
    return levels
