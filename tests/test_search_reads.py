"""A search reads its store once and makes every population once, however many generations look scores up."""

from pyspark.sql import functions as F

from evenkeel.operators import search
from evenkeel.plans.grid import run_grid

RUN = (
    "run_id int, dataset string, model string, protected_attribute string, target_column string, "
    "population_size int, generations int, alpha double, beta double"
)
STORED = (
    "dataset string, model string, protected_attribute string, target_column string, techniques array<string>, "
    "fitness double, fairness double, performance double"
)


def counted(spark, rows, schema):
    """A table of ``rows`` and the number of rows that were made for it so far."""
    seen = spark.sparkContext.accumulator(0)

    def mark(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(mark), schema), seen


def test_the_store_is_read_once(spark):
    runs = spark.createDataFrame([(i, "d", "lr", "sex", "y", 4, 3, 0.5, 0.5) for i in range(5)], RUN)
    rows = [("d", "lr", "sex", "y", [name], 0.5, 0.1, 0.9) for name in ("standard", "ipw", "matching")]
    store, seen = counted(spark, rows, STORED)
    found = run_grid(runs, store)
    assert found.count() == 5 and found.filter("error is not null").count() == 0
    assert seen.value == len(rows)


def test_a_population_is_made_once(spark):
    held = []

    def score(population):
        held.append(population.storageLevel.useMemory)
        return population.withColumn("fitness", F.size("techniques").cast("double"))

    runs = spark.createDataFrame([(i, 3, 2, 0.5, 0.5) for i in range(4)], "run_id int, population_size int, generations int, alpha double, beta double")
    assert search.genetic_search(runs, score).count() == 4
    assert held == [True, True]
