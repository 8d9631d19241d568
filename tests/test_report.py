"""The one-pass report against the separate metrics, and prefix sums with and without cells."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.hashing import uniform
from evenkeel.operators import metrics, ordering
from evenkeel.operators.joins import keyed_join

KEYS = ["run", "fold"]


@pytest.fixture(scope="module")
def preds(spark):
    """Ties, NULLs in every column, a fold of one class and a NULL run."""
    part = lambda name, k: F.floor(uniform(name, "id") * k).cast("int")
    df = spark.range(3000).select(
        "id", F.when(part("r", 4) < 3, part("r", 4)).alias("run"), part("f", 3).alias("fold"), part("y", 2).alias("y"), part("s", 2).alias("s"),
        part("p", 2).alias("pred"), (part("c", 50) / F.lit(50.0)).alias("score"),
    )
    df = df.withColumn("y", F.when((F.col("run") == 0) & (F.col("fold") == 0), 1).otherwise(F.col("y")))
    return df.withColumns({c: F.when((F.col("run") != 2) | (uniform("no" + c, "id") > 0.05), F.col(c)) for c in ("y", "s", "pred", "score")}).cache()


def rows(df):
    return {(r["run"], r["fold"]): tuple(r[c] for c in ("performance", "used_accuracy", *metrics.METRICS)) for r in df.collect()}


@pytest.mark.parametrize("cell", [100_000, 20])
def test_one_pass_equals_the_separate_metrics(preds, monkeypatch, cell):
    monkeypatch.setattr(ordering, "CELL_ROWS", cell)
    want = rows(keyed_join(metrics.performance(preds, KEYS), metrics.fairness(preds, KEYS), KEYS))
    got = rows(metrics.fold_report(preds, KEYS))
    assert set(got) == set(want) and len(got) == 12
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12, nan_ok=True)
    assert any(x[1] for x in got.values()) and any(x[2] is None for x in got.values())


def test_report_of_no_rows_is_empty(preds):
    assert metrics.fold_report(preds.limit(0), KEYS).collect() == []


def test_predictions_are_read_once(preds, spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = T.StructType(preds.schema.fields)
    metrics.fold_report(preds.mapInArrow(count, schema), KEYS).collect()
    assert seen.value == preds.count()


def test_prefix_sums_are_the_same_in_one_cell_and_in_many(spark):
    counts = spark.range(200).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("double").alias("v"), (F.col("id") % 5).alias("n"))
    one = ordering.prefix_sums(counts, ["k"], "v", ["n"], [])
    many = ordering.prefix_sums(counts, ["k"], "v", ["n"], [10.0, 30.0, 60.0])
    assert one.columns == many.columns and sorted(one.collect()) == sorted(many.collect())
