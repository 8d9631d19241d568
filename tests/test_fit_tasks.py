"""The training rows of a fit are dealt over the cores, however few or many blocks they are read from."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenkeel.plans import evaluate


def test_fits_take_the_cores_between_them():
    assert evaluate.fit_tasks(10_000, 1, 12) == 1
    assert evaluate.fit_tasks(720_000, 1, 12) == 12 and evaluate.fit_tasks(720_000, 8, 12) == 2
    assert evaluate.fit_tasks(480_000_000, 1, 12) == 120


def test_training_rows_of_one_block_are_dealt_out(spark, monkeypatch):
    rows = spark.range(400).coalesce(1).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"),
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 2).cast("double"))).alias("features"),
    )
    seen = []
    build = evaluate.build_classifier

    class Watched:
        def __init__(self, *args):
            self.made = build(*args)

        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))
            return self.made.fit(train)

    monkeypatch.setattr(evaluate, "TASK_ROWS", 100)
    monkeypatch.setattr(evaluate, "build_classifier", Watched)
    found = evaluate.fit_predict(rows.select("y", "features"), rows, "lr")
    assert seen == [(4, 400)]
    assert found.filter("pred = y").count() == 400
