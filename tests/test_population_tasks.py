"""The first population is made by tasks as many as its individuals need, not as the runs have files."""

from pyspark.sql import functions as F

from evenkeel.operators import search


def test_population_of_one_block_is_dealt_over_tasks(spark):
    runs = spark.range(9_000).coalesce(1).select(F.col("id").alias("run_id"), F.lit(10).alias("population_size"))
    made = search.initial_population(runs)
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) < 2 * search.TASK_ROWS
    assert made.select("run_id", "slot").distinct().count() == 90_000
    assert search.initial_population(runs.limit(0)).count() == 0
