"""Batched forests against a plain version that grows one tree of one run at a time."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenkeel.plans import evaluate, forests
from evenkeel.plans.forests import Plan


def gini(rows):
    total, ones = sum(w for _, w, _ in rows), sum(w for y, w, _ in rows if y)
    return 2 * ones * (total - ones) / total if total else 0.0


def plain(rows, forest, plan):
    """Probabilities of all rows (y, weight, bins) of one run; the row number is its place."""
    out, width = np.zeros(len(rows)), len(rows[0][2])
    for tree in range(plan.trees):
        bag = forests.bags(np.arange(len(rows), dtype=np.uint64), tree, plan.seed)
        level = [([(y, w * int(b), x) for (y, w, x), b in zip(rows, bag) if b], list(range(len(rows))))]
        for depth in range(plan.depth + 1):
            choices, below = forests._choices(plan.seed, tree, depth, max(1, len(level)), width), []
            for (drawn, members), mine in zip(level, choices):
                best = (1e-9, None)
                for f in mine if depth < plan.depth else ():
                    for cut in range(plan.bins - 1):
                        left, right = [r for r in drawn if r[2][f] <= cut], [r for r in drawn if r[2][f] > cut]
                        gain = gini(drawn) - gini(left) - gini(right)
                        if left and right and gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
                total = sum(w for _, w, _ in drawn)
                sides = [(drawn, members)]
                if best[1]:
                    f, cut = best[1]
                    sides = [([r for r in drawn if (r[2][f] > cut) == s], [i for i in members if (rows[i][2][f] > cut) == s]) for s in (False, True)]
                for some, here in sides:
                    if best[1] and 0 < sum(w for y, w, _ in some if y) < sum(w for _, w, _ in some) and depth + 1 < plan.depth:
                        below.append((some, here))
                    else:
                        out[here] += sum(w for y, w, _ in some if y) / sum(w for _, w, _ in some) if total else 0
            level = below
            if not level:
                break
    return out / plan.trees


@pytest.fixture(scope="module")
def table(spark):
    rnd, rows = random.Random(5), []
    for run in range(3):
        for _ in range(150):
            f = [rnd.random(), float(rnd.randint(0, 3)), 7.0, rnd.gauss(0, 1)]
            rows.append((run, float(f[0] + 0.3 * f[1] + rnd.gauss(0, 0.2) > 0.8), rnd.choice([1.0, 0.5, 2.0]) if run else 1.0, f))
    frame = spark.createDataFrame(rows, "run int, y double, weight double, features array<double>")
    return frame.coalesce(1).orderBy("run").coalesce(1).persist(), rows


def test_equals_a_plain_forest_of_each_run(table, monkeypatch):
    df, _ = table
    rows = [tuple(r) for r in df.collect()]
    plan = Plan(trees=4, depth=4, bins=8)
    for block, most in ((20_000, 256 << 20), (50, 1)):  # one task and pass; several tasks, one pass a tree
        monkeypatch.setattr(forests, "BLOCK_ROWS", block)
        monkeypatch.setattr(forests, "HISTOGRAM_BYTES", most)
        forest = forests.fit(df, 4, plan)
        start = 0
        for run in range(3):
            mine = [r[1:] for r in rows if r[0] == run]
            got = forest.probability(np.full(len(mine), run), np.array([f for *_, f in mine]))
            monkeypatch.setattr(forests, "bags", lambda key, t, seed, at=start, f=forests.bags: f(key + np.uint64(at), t, seed))
            bins = forests.to_bins(forest.edges, np.array([f for *_, f in mine])).T.tolist()
            want = plain([(y, w, x) for (y, w, _), x in zip(mine, bins)], forest, plan)
            monkeypatch.undo()
            monkeypatch.setattr(forests, "BLOCK_ROWS", block)
            monkeypatch.setattr(forests, "HISTOGRAM_BYTES", most)
            assert np.allclose(got, want, atol=1e-9)
            start += len(mine)


def test_bags_are_poisson_and_differ_by_tree():
    key = np.arange(200_000, dtype=np.uint64)
    a, b = forests.bags(key, 0, 42), forests.bags(key, 1, 42)
    for bag in (a, b):
        assert abs(bag.mean() - 1) < 0.01 and abs(bag.var() - 1) < 0.02 and abs((bag == 0).mean() - 0.3679) < 0.005
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_bags_are_those_of_the_poisson_table():
    key = np.arange(300_000, dtype=np.uint64) * np.uint64(977)
    for tree in (0, 99):
        salt = forests._mixed(np.array([(42 << 20) + tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        drawn = (forests._mixed(key ^ salt) >> np.uint64(11)) * 2.0**-53
        assert (forests.bags(key, tree, 42) == np.searchsorted(forests.BAG, drawn, "right")).all()


def test_states_are_held_for_as_many_trees_as_the_limit_allows(table, spark, monkeypatch):
    """The trees do not depend on it, and each state is a value of its own, not one of all trees."""
    df, _ = table
    plan, rows = Plan(trees=5, depth=4, bins=8), df.persist()
    whole, held = forests.fit(rows, 4, plan), []
    monkeypatch.setattr(forests, "STATE_BYTES", 2 * 2 * 450 // spark.sparkContext.defaultParallelism + 1)  # two trees
    monkeypatch.setattr(forests, "_grow_group", lambda *a, f=forests._grow_group: held.append(len(a[2])) or f(*a))
    parted = forests.fit(rows, 4, plan)
    assert held == [2, 2, 1]
    run, features = np.arange(600) % 3, np.random.default_rng(1).random((600, 4)) * 3
    assert (whole.probability(run, features) == parted.probability(run, features)).all()
    one = forests.Rows(0, np.arange(9, dtype=np.uint64), np.ones(1), np.zeros((4, 9), np.uint8))
    assert [x[1].nbytes for x in list(forests._begun(one, plan, 1, 4))[1:]] == [18, 18, 18]


def test_a_rare_least_value_keeps_a_bin(spark):
    rows = spark.range(1000).select(F.array((F.col("id") > 0).cast("double")).alias("features"))
    edges = forests.bin_edges(rows, 1, 32)
    assert forests.to_bins(edges, np.array([[0.0], [1.0]])).tolist() == [[0, 1]]


@pytest.fixture(scope="module")
def noisy(spark):
    """Two halves of rows whose label follows four of five features, with noise."""
    h = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000).cast("double")
    rows = spark.range(6000).select(F.col("id").alias("row_id"), *[h(k).alias(f"f{k}") for k in range(5)], h(9).alias("noise"))
    y = ((F.col("f0") + F.col("f1") * F.col("f2") - F.col("f3") + 0.6 * F.col("noise")) > 0.55).cast("int").alias("y")
    rows = rows.select("row_id", y, array_to_vector(F.array(*[f"f{k}" for k in range(5)])).alias("features"))
    return rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1")


def test_is_as_good_as_the_forest_of_pyspark(noisy, monkeypatch):
    train, test = noisy
    monkeypatch.setattr(evaluate, "TASK_ROWS", 1000)
    right = lambda df: df.filter("pred = y").count() / 3000
    ours = evaluate.fit_predict(train, test, "rf")
    theirs = evaluate.build_classifier("rf", 3000).fit(train.coalesce(1)).transform(test).select("y", F.col("prediction").alias("pred"))
    assert abs(right(ours) - right(theirs)) < 0.02


def test_forests_of_all_parts_take_a_pass_a_level(noisy, monkeypatch):
    """One shuffle a level for all folds together, and no fit of a single forest."""
    train, test = noisy
    plan, seen = Plan(trees=5, depth=3), []
    monkeypatch.setattr(evaluate, "TASK_ROWS", 1000)
    monkeypatch.setattr(evaluate, "FOREST", plan)
    monkeypatch.setattr(evaluate, "build_classifier", lambda *_: pytest.fail("a forest was fitted alone"))
    from pyspark import RDD

    monkeypatch.setattr(RDD, "partitionBy", lambda rdd, *a, f=RDD.partitionBy: seen.append(1) or f(rdd, *a))
    found = evaluate.predict_all([evaluate.Part(train, test), evaluate.Part(test, train)], ["rf"])
    assert sorted(found) == [(0, "rf"), (1, "rf")] and all(x.count() == 3000 for x in found.values())
    assert len(seen) == plan.depth


def test_rows_for_one_task_keep_the_forest_of_pyspark(noisy, monkeypatch):
    train, test = noisy
    monkeypatch.setattr(forests, "fit", lambda *_: pytest.fail("a small forest was grown together"))
    ours = evaluate.fit_predict(train, test, "rf").select("row_id", "pred")
    theirs = evaluate.build_classifier("rf", 3000).fit(train.coalesce(1)).transform(test)
    assert ours.exceptAll(theirs.select("row_id", F.col("prediction").cast("int").alias("pred"))).count() == 0


def test_other_labels_and_an_alike_part_beside(noisy, monkeypatch):
    train, test = noisy
    monkeypatch.setattr(evaluate, "TASK_ROWS", 1000)
    three = train.withColumn("y", F.when(F.col("row_id") % 10 == 0, 2).otherwise(F.col("y")))
    found = evaluate.predict_all([evaluate.Part(three, test), evaluate.Part(train, test)], ["rf"])
    assert all(x.count() == 3000 for x in found.values())
    alone = evaluate.fit_predict(train, test, "rf")
    assert alone.exceptAll(found[1, "rf"]).count() == 0  # the same alone and beside others
