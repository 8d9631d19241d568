import math

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import folds, groups, metrics

INF = float("inf")


def preds(spark, sex, y, pred):
    rows = [(i, 0, s, t, p) for i, (s, t, p) in enumerate(zip(sex, y, pred))]
    return spark.createDataFrame(rows, "row_id int, fold int, s int, y int, pred int")


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "pred,spd,di", [([0, 0, 0, 1, 0, 0], 1 / 3, INF), ([0] * 6, 0.0, None)]
)
def test_unbounded_and_undefined_impact(spark, pred, spd, di):
    df = preds(spark, [1, 1, 1, 0, 0, 0], [1, 0, 0, 1, 0, 0], pred)
    r = one(metrics.fairness(df, ["fold"]))
    assert r["statistical_parity"] == pytest.approx(spd)
    assert r["disparate_impact"] == di


def test_perfect_predictions_on_balanced_groups_are_fair(spark):
    y = [1, 1, 1, 0, 0, 0] * 2
    r = one(metrics.fairness(preds(spark, [1] * 6 + [0] * 6, y, y), ["fold"]))
    assert (r["statistical_parity"], r["equal_opportunity"], r["disparate_impact"]) == (0, 0, 0)


def test_a_missing_group_or_label_is_undefined(spark):
    alone = preds(spark, [1, 1], [1, 0], [1, 1])
    assert one(metrics.fairness(alone, ["fold"]))["disparate_impact"] is None
    holes = preds(spark, [1, 0], [None, 0], [1, 1])
    assert one(metrics.fairness(holes, ["fold"]))["statistical_parity"] is None


def fold_table(spark, perf, fair):
    rows = [(i, p, f, 0.0 if f is not None else None, 0.0 if f is not None else None) for i, (p, f) in enumerate(zip(perf, fair))]
    return spark.createDataFrame(
        rows, "fold int, performance double, disparate_impact double, statistical_parity double, equal_opportunity double"
    ).withColumn("run", F.lit(1))


@pytest.mark.parametrize(
    "perf,fair,expected",
    [
        ([0.8, 0.9], [0.6, 0.6], (0.325, 0.2, 0.85)),
        ([0.8, 0.9, 0.7], [0.6, None, 0.3], (0.325, 0.15, 0.8)),
        ([0.8, 0.9], [0.6, INF], (-INF, INF, 0.85)),
        ([0.8, 0.9], [None, None], (-INF, None, 0.85)),
        ([0.8, 0.9], [None, INF], (-INF, INF, 0.85)),
    ],
)
def test_combined_fitness(spark, perf, fair, expected):
    r = one(metrics.combined_fitness(fold_table(spark, perf, fair), ["run"]))
    got = (r["fitness"], r["fairness_score"], r["performance_score"])
    for g, e in zip(got, expected):
        assert g is None if e is None else g == pytest.approx(e)


@pytest.mark.parametrize("values,expected", [([0.2, None, 0.4], 0.3), ([None, None], None), ([0.1, INF], INF)])
def test_metric_fold_mean(spark, values, expected):
    df = spark.createDataFrame([(1, v) for v in values], "run int, m double")
    got = one(metrics.metric_fold_means(df, ["run"], ["m"]))["m"]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_baseline_fairness_worst_value_when_undefined(spark):
    r = one(metrics.baseline_fairness(fold_table(spark, [1.0, 1.0], [0.6, INF]), ["run"]))
    assert (r["fairness_score"], r["undefined_fairness_folds"], r["fairness_undefined"]) == (1.0, 1, True)
    r = one(metrics.baseline_fairness(fold_table(spark, [1.0, 1.0], [0.6, 0.3]), ["run"]))
    assert r["fairness_score"] == pytest.approx(0.15) and r["fairness_undefined"] is False


def brute_ap(y, score):
    total, last, out = sum(y), 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        chosen = [a for a, b in zip(y, score) if b >= t]
        recall = sum(chosen) / total
        out += (recall - last) * sum(chosen) / len(chosen)
        last = recall
    return out


def test_average_precision_with_ties(spark, monkeypatch):
    from evenkeel.operators import ordering

    monkeypatch.setattr(ordering, "CELL_ROWS", 7)
    y = [(i * 7919) % 3 == 0 for i in range(200)]
    score = [((i * 31) % 17) / 17 for i in range(200)]
    df = spark.createDataFrame([(1, int(a), b) for a, b in zip(y, score)], "run int, y int, score double")
    got = one(metrics.average_precision(df, ["run"]))["average_precision"]
    assert got == pytest.approx(brute_ap([int(a) for a in y], score))


def test_group_rules(spark):
    df = spark.createDataFrame(
        [(1, "Male", 1.9, 20), (2, "m", 2.0, 30), (3, "female", None, 40), (4, None, 1.0, None)],
        "id int, sex string, race double, age int",
    )

    def s(column, rule=None):
        out = groups.privileged(df, column, [], "id", rule)
        return [r["s"] for r in out.orderBy("id").collect()]

    assert s("sex") == [1, 1, 0, 0]
    assert s("race") == [1, 0, 0, 1]
    assert s("age") == [0, 0, 1, 0]  # the mean, 30, is not above itself
    assert s("sex", "mode") == [1, 0, 0, 0]  # all tied: the first value seen wins
    with pytest.raises(ValueError):
        groups.privileged(df, "sex", [], "id", "other")


def test_null_mode_privileges_nobody(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, c string")
    assert [r["s"] for r in groups.privileged(df, "c", [], "id").collect()] == [0, 0, 0]


def test_label_coercion(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, y int")
    assert [r["out"] for r in groups.coerce_labels(df, "y", [], "id", "out").orderBy("id").collect()] == [0, 1, None]
    bad = spark.createDataFrame([(1, 1), (2, 3)], "id int, y int")
    assert [r["out"] for r in groups.coerce_labels(bad, "y", [], "id", "out").collect()] == [None, None]


def test_folds_are_even_and_stratified(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = sorted(r["count"] for r in folds.kfold(df, "id").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    cells = folds.stratified_kfold(df, "y", "id").groupBy("fold", "y").count().collect()
    ones = [r["count"] for r in cells if r["y"] == 1]
    assert len(ones) == 5 and max(ones) - min(ones) <= 1


def test_minmax_score(spark):
    df = spark.createDataFrame([(1, 0, -2.0), (2, 0, 2.0), (3, 1, 5.0)], "id int, fold int, raw double")
    got = [r["score"] for r in metrics.score_minmax(df, "raw", ["fold"], "id").orderBy("id").collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] == 0 and not math.isnan(got[2])
