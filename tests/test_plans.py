import pytest
from pyspark.sql import functions as F

from evenkeel import Roles
from evenkeel.functions.hashing import uniform
from evenkeel.plans import evaluate, grid

ROLES = Roles("id", "target", "sex")


@pytest.fixture(scope="module")
def sample(spark):
    """Two hundred rows whose label follows one feature and, a little, the group."""
    df = spark.range(200).withColumns({f"f{i}": uniform(i, "id") for i in range(3)})
    df = df.withColumn("sex", (uniform("sex", "id") < 0.5).cast("int"))
    return df.withColumn("target", (F.col("f0") + 0.1 * F.col("sex") + 0.2 * uniform("e", "id") > 0.65).cast("int")).cache()


def test_evaluation_of_a_practice_list(sample):
    r = evaluate.evaluate_practices(sample, ["ipw", "min_max_scaling"], "lr", ROLES).first()
    assert 0.8 < r["performance_score"] <= 1 and 0 <= r["fairness_score"]
    assert r["fitness"] == pytest.approx(0.5 * r["performance_score"] - 0.5 * r["fairness_score"])


def test_single_class_target_is_infeasible(sample):
    r = evaluate.evaluate_practices(sample.withColumn("target", F.lit(1)), [], "lr", ROLES).first()
    assert r["fitness"] == float("-inf") and r["performance_score"] is None


def test_unknown_model():
    with pytest.raises(ValueError):
        evaluate.build_classifier("tree", 10)


@pytest.mark.parametrize("method,model", [("fairsmote", "svc"), ("Reweighing", "lr"), ("dir", "lr")])
def test_baselines_end_to_end(sample, method, model):
    r = evaluate.evaluate_baseline(sample, method, model, ROLES).first()
    assert 0.5 < r["performance_score"] <= 1 and 0 <= r["fairness_score"] <= 1
    assert r["fairness_undefined"] is False and r["elapsed_seconds"] >= 0


def test_failed_baseline_becomes_a_row(sample):
    broken = sample.withColumn("f0", F.when(F.col("id") != 3, F.col("f0")))
    r = grid.baseline_method_rows(broken, ROLES, "d", ["lr"], ["DIR"]).first()
    assert r["performance_score"] is None and r["elapsed_seconds"] == 0 and "NonFiniteError" in r["error"]


def test_search_rows_lose_invalid_metrics(spark):
    df = spark.createDataFrame(
        [("d", "sex", "lr", 0.4, 0.1, 0.9, 5.0, None), ("d", "sex", "rf", float("-inf"), None, 0.9, 5.0, None), ("d", "sex", "svc", None, None, None, 5.0, "boom")],
        "dataset string, protected_attribute string, model_identifier string, fitness double, fairness_score double, performance_score double,"
        " elapsed_seconds double, error string",
    )
    got = {r["model_identifier"]: r for r in grid.search_method_rows(df).collect()}
    assert got["lr"]["error"] is None and got["lr"]["performance_score"] == 0.9
    assert got["rf"]["error"] == "no feasible pipeline found" and got["rf"]["performance_score"] is None
    assert got["svc"]["error"] == "boom"
