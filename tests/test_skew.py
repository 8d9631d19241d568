"""The paths for many groups and hot groups give the same rows as the broadcast path."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evenkeel import Roles
from evenkeel.operators import joins, mitigation, ordering, practices

ROLES = Roles("id", "y", "g")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group and one value."""
    rnd = random.Random(5)
    rows = [
        (i, 0 if i % 3 == 0 else rnd.randrange(1, 60), 1.5 if i % 3 == 0 else rnd.random(), i % 2) for i in range(3000)
    ]
    return spark.createDataFrame(rows, "id int, g int, v double, y int").cache()


def both(monkeypatch, job):
    usual = sorted(map(tuple, job().collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(mitigation, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_PARTS", 20)
    monkeypatch.setattr(ordering, "CELL_ROWS", 100)
    monkeypatch.setattr(practices, "DRAWS_PER_COPY", 3)
    assert sorted(map(tuple, job().collect())) == usual
    return usual


@pytest.mark.parametrize("name", ["undersampling", "stratified_sampling", "oversampling", "ipw"])
def test_practices(skewed, monkeypatch, name):
    assert both(monkeypatch, lambda: practices.PRACTICES[name](skewed, ROLES))


def test_repair(skewed, monkeypatch):
    assert both(monkeypatch, lambda: mitigation.repair_features(skewed, ROLES, ["v"]))


def _features(df, count):
    """``count`` features; the last has NULLs, and some rows have no group."""
    wide = df.withColumns({f"f{i}": F.col("v") * (i + 1) + F.col("id") % (i + 2) for i in range(count - 1)})
    wide = wide.withColumn("last", F.when(F.col("id") % 5 != 0, F.col("v")))
    return wide.withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g"))).drop("v")


def test_repair_of_several_features(skewed, monkeypatch):
    df = _features(skewed, 4)
    rows = both(monkeypatch, lambda: mitigation.repair_features(df, ROLES).select("id", "g", "f0", "last"))
    assert len(rows) == 3000
    assert all((r[3] is None) == (r[0] % 5 == 0 or r[1] is None) for r in rows)
    assert all((r[2] is None) == (r[1] is None) for r in rows)


def test_repair_joins_do_not_grow_with_features(skewed, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(mitigation, "BROADCAST_ROWS", 5)

    def shuffles(count):
        plan = mitigation.repair_features(_features(skewed, count), ROLES)._jdf.queryExecution().sparkPlan()
        return plan.toString().count("SortMergeJoin") + plan.toString().count("BroadcastHashJoin")

    assert shuffles(2) == shuffles(6)


def test_left_attach_keeps_unmatched_rows(skewed, monkeypatch):
    groups = skewed.filter("g % 2 = 0").groupBy("g").agg(F.count("*").alias("n"))
    out = both(monkeypatch, lambda: joins.attach(skewed, groups, ["g"], "n", F.col("id"), "left"))
    assert len(out) == 3000


def test_quantiles(skewed, monkeypatch):
    out = both(monkeypatch, lambda: ordering.exact_quantiles(skewed, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.97}))
    values = {}
    for r in skewed.collect():
        values.setdefault(r["g"], []).append(r["v"])
    for g, _, median, _ in out:
        assert median == pytest.approx(statistics.median(values[g]))


def test_ranks_are_dense(skewed):
    out = ordering.hash_rank(skewed, ["g"], "id", 1).collect()
    ranks = {}
    for r in out:
        ranks.setdefault(r["g"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 3)], "g string, n bigint")
    out = joins.explode_range(df, F.col("n"), "i", chunk=4).groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("i"))
    assert {r["g"]: r["i"] for r in out.collect()} == {"a": list(range(25)), "c": [0, 1, 2]}


def test_no_unpartitioned_window_on_rows(skewed):
    """Row-level sorts are always split by a cell; only cell counts may be ordered globally."""
    plan = ordering.hash_rank(skewed, [], "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and all("__cell" in line for line in windows)
