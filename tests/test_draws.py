"""Draws with replacement never pass through the driver."""

from evenkeel.operators.practices import oversampling
from evenkeel.operators.mitigation import quadrant_oversample
from evenkeel.roles import Roles


def _joins_of_draws(df):
    """The joins of the executed plan that look up drawn ranks."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Join" in line and "__copy" in line]


def test_draws_are_joined_by_a_shuffle(spark):
    rows = spark.createDataFrame([(i, i % 7 == 0, float(i)) for i in range(700)], "row_id long, g boolean, x double")
    done = oversampling(rows, Roles("row_id", "x", "g"))
    joins = _joins_of_draws(done)
    assert joins and not [j for j in joins if "Broadcast" in j]
    assert done.groupBy("g").count().collect()[0]["count"] == 600


def test_drawn_quadrants_are_joined_by_a_shuffle(spark):
    rows = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 3 == 0)) for i in range(300)], "row_id long, y int, s int")
    done = quadrant_oversample(rows, "y", "s", "row_id")
    joins = _joins_of_draws(done)
    assert joins and not [j for j in joins if "Broadcast" in j]
    assert {r["count"] for r in done.groupBy("y", "s").count().collect()} == {160}
