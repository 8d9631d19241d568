"""Batched boosting against a plain version that grows one tree of one run at a time."""

import math
import random

import numpy as np
import pytest
from pyspark import RDD

from evenkeel.plans import boosting
from evenkeel.plans.boosting import Plan


def plain(rows, edges, plan):
    """Margins of all rows of one run: (y, weight, features)."""
    bins = [[sum(e < x for e in edge) for x, edge in zip(f, edges)] for _, _, f in rows]
    margin = [0.0] * len(rows)

    def grow(members, depth, g, h, out):
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        best = (1e-6, None)
        for f in range(len(edges)) if depth < plan.depth else ():
            for cut in range(plan.bins - 1):
                left = [i for i in members if bins[i][f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gr, hr = total_g - gl, total_h - hl
                if hl >= plan.least and hr >= plan.least:
                    gain = gl**2 / (hl + plan.ridge) + gr**2 / (hr + plan.ridge) - total_g**2 / (total_h + plan.ridge)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut))
        if best[1] is None:
            for i in members:
                out[i] = -plan.rate * total_g / (total_h + plan.ridge)
            return
        f, cut = best[1]
        grow([i for i in members if bins[i][f] <= cut], depth + 1, g, h, out)
        grow([i for i in members if bins[i][f] > cut], depth + 1, g, h, out)

    for _ in range(plan.trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [(p[i] - y) * w for i, (y, w, _) in enumerate(rows)]
        h = [max(p[i] * (1 - p[i]), 1e-16) * w for i, (_, w, _) in enumerate(rows)]
        out = [0.0] * len(rows)
        grow(list(range(len(rows))), 0, g, h, out)
        margin = [m + o for m, o in zip(margin, out)]
    return margin


@pytest.fixture(scope="module")
def table(spark):
    rnd, rows = random.Random(4), []
    for run in range(3):
        for _ in range(160):
            f = [rnd.random(), float(rnd.randint(0, 3)), 7.0, rnd.gauss(0, 1)]
            rows.append((run, float(f[0] + 0.3 * f[1] + rnd.gauss(0, 0.2) > 0.8), rnd.choice([1.0, 0.5, 2.0]), f))
    return spark.createDataFrame(rows, "run int, y double, weight double, features array<double>"), rows


def test_equals_plain_boosting_of_each_run(table, monkeypatch):
    df, rows = table
    plan = Plan(trees=5, depth=3, bins=8, checkpoint=2)
    for block, most in ((25_000, 64 << 20), (100, 1)):  # one block and pass; several blocks, one pass a feature
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", most)
        forest = boosting.fit(df, 3, 4, plan)
        for run in range(3):
            mine = [(y, w, f) for r, y, w, f in rows if r == run]
            got = forest.probability(np.full(len(mine), run), np.array([f for *_, f in mine]))
            want = [1 / (1 + math.exp(-m)) for m in plain(mine, forest.edges, plan)]
            assert np.allclose(got, want, atol=1e-9)


def test_prediction_keeps_the_other_columns(table, spark):
    df, rows = table
    forest = boosting.fit(df, 3, 4, Plan(trees=8, depth=3, bins=16))
    got = forest.predict(df).collect()
    assert [c for c in got[0].asDict()] == ["run", "y", "weight", "raw"] and len(got) == len(rows)
    assert sum((r.raw > 0.5) == (r.y > 0.5) for r in got) > 0.9 * len(rows)
    assert forest.predict(df.limit(0)).collect() == []


def test_passes_do_not_depend_on_the_number_of_runs(table, monkeypatch):
    df, _ = table
    seen = []
    monkeypatch.setattr(boosting, "_best", lambda full, plan, f=boosting._best: seen.append(1) or f(full, plan))
    plan = Plan(trees=2, depth=2, bins=8)
    boosting.fit(df, 3, 4, plan)
    all_runs = len(seen)
    boosting.fit(df.where("run = 0"), 1, 4, plan)
    assert all_runs <= plan.trees * plan.depth and len(seen) - all_runs == all_runs


def test_a_pass_has_as_many_tasks_as_cores_and_hands_on_their_own_runs(table, spark, monkeypatch):
    df, _ = table
    seen = []

    def reduce(rdd, f, depth, tree=RDD.treeReduce):
        parts = rdd.collect()
        seen.append((rdd.getNumPartitions(), sum(len(p) for p in parts)))
        return tree(rdd, f, depth)

    monkeypatch.setattr(boosting, "BLOCK_ROWS", 10)
    monkeypatch.setattr(RDD, "treeReduce", reduce)
    boosting.fit(df, 3, 4, Plan(trees=1, depth=2, bins=8))
    cores = spark.sparkContext.defaultParallelism
    assert seen and all(tasks <= cores and held < 3 + cores for tasks, held in seen)


def test_rows_of_one_run_take_the_same_way_byte_by_byte():
    rng = np.random.default_rng(3)
    trees, bins = boosting.Trees.empty(2, 6), rng.integers(0, 64, (5, 4000)).astype(np.uint8)
    trees.feature[:, 1:64], trees.cut[:, 1:64] = rng.integers(0, 5, (2, 63)), rng.integers(5, 55, (2, 63))
    trees.feature[1, [5, 8, 19]] = -1
    for depth in range(7):
        wide = trees.nodes(np.ones(4000, int), bins, depth)
        assert (trees.nodes(np.array([1]), bins, depth) == wide).all()


def test_a_worker_settles_once(table, monkeypatch):
    monkeypatch.setattr(boosting, "_settled", [])
    seen = []
    monkeypatch.setattr(boosting.gc, "freeze", lambda: seen.append(1))
    for _ in range(3):
        list(boosting._sums(iter(()), boosting.Trees.empty(1, 2), 0, 8, 0, 1))
    assert seen == [1]
