"""The compacted score store: last rows, look-ups without a shuffle of the store, clashes of hashes."""

import json

import pytest
from pyspark.sql import functions as F

from evenkeel.sources import scores

RAW = (
    "dataset string, model string, protected_attribute string, target_column string, techniques string, fitness string,"
    " fairness string, performance string, ord long"
)
ASKED = "dataset string, model string, protected_attribute string, target_column string, techniques array<string>, ord long"


def store_rows(count):
    """``count`` keys, every third stored twice with other scores, every fifth infeasible, every seventh unscored."""
    rows = []
    for i in range(count):
        fitness = "" if i % 7 == 0 else "NaN" if i % 5 == 0 else str(i / 100)
        key = ("d", ["lr", "rf"][i % 2], "sex", "y", json.dumps([f"p{i}", "q"][: 1 + i % 2]))
        if i % 3 == 0:
            rows.append((*key, "0.77", "0.1", "0.2", 2 * i))
        rows.append((*key, fitness, "", "0.5", 2 * i + 1))
    return rows


@pytest.fixture()
def compacted(spark, tmp_path):
    name = "compacted_scores"
    raw = spark.createDataFrame(store_rows(300), RAW)
    scores.compact_scores(raw, "ord", name, str(tmp_path / "store"), 4)
    yield raw, name
    spark.sql(f"drop table if exists {name}")


def requests(spark):
    """Every key with an even number, one asked for by a third of all rows, and keys that are not stored."""
    lists = [(["lr", "rf"][i % 2], [f"p{i}", "q"][: 1 + i % 2]) for i in range(0, 400, 2)]
    lists += [("rf", ["p11", "q"])] * 100
    return spark.createDataFrame([("d", m, "sex", "y", t, i) for i, (m, t) in enumerate(lists)], ASKED)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("ord", "techniques", *scores.SCORES).collect()), key=str)


def test_compaction_keeps_the_last_row(compacted, spark):
    raw, name = compacted
    expected = scores.load_scores(raw, "ord")
    got = spark.table(name).drop(scores.KEY_HASH)
    assert got.count() == 300
    assert got.exceptAll(expected.select(got.columns)).isEmpty()


def test_lookup_equals_the_plain_one(compacted, spark):
    raw, name = compacted
    asked = requests(spark)
    found = rows_of(scores.lookup_compacted(asked, name, "ord"))
    assert found == rows_of(scores.score_lookup(asked, scores.load_scores(raw, "ord"), None, "ord"))
    assert len(found) == 300 and any(r[2] is not None for r in found) and any(r[2] is None for r in found)


def test_lookup_of_nothing_and_in_nothing(spark, tmp_path, compacted):
    _, name = compacted
    asked = requests(spark)
    assert scores.lookup_compacted(asked.limit(0), name, "ord").count() == 0
    scores.compact_scores(spark.createDataFrame([], RAW), "ord", "no_scores", str(tmp_path / "none"), 4)
    assert {r[2] for r in rows_of(scores.lookup_compacted(asked, "no_scores", "ord"))} == {None}
    spark.sql("drop table no_scores")


def test_the_store_is_not_shuffled(compacted, spark):
    _, name = compacted
    wanted = requests(spark).select(F.xxhash64("dataset").alias(scores.KEY_HASH)).distinct()
    joined = wanted.join(spark.table(name).hint("merge"), scores.KEY_HASH)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    store_side = plan[plan.index("SortMergeJoin"):].split("FileScan")[0].rsplit("\n", 12)
    assert "SelectedBucketsCount: 4 out of 4" in plan
    assert sum("Exchange hashpartitioning(key_hash" in line for line in store_side) <= 1
    assert plan.count("Exchange") <= 2  # distinct, and its rows to the buckets


def test_keys_of_equal_hash_are_told_apart(compacted, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scores.F, "xxhash64", lambda *keys: F.length(F.col("model")).cast("long"))
    raw, _ = compacted
    scores.compact_scores(raw, "ord", "clashing_scores", str(tmp_path / "clash"), 2)
    asked = requests(spark)
    found = rows_of(scores.lookup_compacted(asked, "clashing_scores", "ord"))
    assert found == rows_of(scores.score_lookup(asked, scores.load_scores(raw, "ord"), None, "ord"))
    spark.sql("drop table clashing_scores")
