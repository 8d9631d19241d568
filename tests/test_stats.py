import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import analysis, stats

KEYS = ["h"]


def pair_table(spark, groups):
    rows = [(h, i, float(x), float(y)) for h, (xs, ys) in groups.items() for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "h string, i int, x double, y double")


def by_key(df, column):
    return {r["h"]: r[column] for r in df.collect()}


def test_a12(spark):
    table = pair_table(spark, {"up": ([3, 4], [1, 2]), "same": ([1, 2], [1, 2]), "down": ([1, 2], [3, 4])})
    assert by_key(stats.a12(table, KEYS), "a12_raw") == {"up": 1.0, "same": 0.5, "down": 0.0}


def test_sign_test(spark):
    table = pair_table(spark, {"ten": ([1] * 10 + [0], [0] * 11), "zero": ([1] * 5, [1] * 5), "even": ([1, 0], [0, 1])})
    got = by_key(stats.sign_test(table, KEYS), "sign_p")
    assert got["ten"] == pytest.approx(2 / 2**10) and got["zero"] == 1.0 and got["even"] == 1.0


@pytest.mark.parametrize("up,n", [(0, 1), (3, 11), (40, 100), (480, 1000)])
def test_binomial_tail(spark, up, n):
    k = min(up, n - up)
    exact = 2 * sum(math.comb(n, j) for j in range(k + 1))
    expected = min(1.0, exact / 2**n if n < 1000 else math.exp(math.log(exact) - n * math.log(2)))
    got = spark.range(1).select(stats.sign_p(F.lit(up), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("z", [0.0, 0.7, 1.96, 5.0, 9.0])
def test_normal_tail(spark, z):
    got = spark.range(1).select(stats.normal_tail(F.lit(z)).alias("p")).first()["p"]
    assert got == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-8)


def brute_signed_rank(d):
    """Exact two-sided p over all sign patterns."""
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    plus = sum(rank[i] for i in rank if d[i] > 0)
    total = len(d) * (len(d) + 1) // 2
    low = min(plus, total - plus)
    sums = [sum(r for r, s in zip(range(1, len(d) + 1), signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * sum(s <= low for s in sums) / len(sums))


def test_signed_rank_exact(spark):
    rnd = random.Random(1)
    groups = {f"n{n}": ([rnd.gauss(0.4, 1) for _ in range(n)], [0.0] * n) for n in (1, 4, 9, 12)}
    got = by_key(stats.signed_rank_test(pair_table(spark, groups), KEYS), "p_value")
    for h, (xs, _) in groups.items():
        assert got[h] == pytest.approx(brute_signed_rank(xs))


def test_signed_rank_known_value(spark):
    # 24 untied pairs with a smaller rank sum of 55
    negative = {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    xs = [-r if r in negative else r for r in range(1, 25)]
    got = stats.signed_rank_test(pair_table(spark, {"h": (xs, [0] * 24)}), KEYS).first()
    assert got["w_minus"] == 55 and got["p_value"] == pytest.approx(0.0053304434, abs=1e-10)


def test_signed_rank_with_zeros_and_ties(spark):
    xs = [1, 1, -1, 2, 0, 3, 3, -2]
    got = stats.signed_rank_test(pair_table(spark, {"h": (xs, [0] * 8), "none": ([1], [1])}), KEYS)
    rows = {r["h"]: r for r in got.collect()}
    assert rows["none"]["p_value"] == 1.0
    h = rows["h"]
    assert (h["n_used"], h["w_plus"], h["w_minus"]) == (7, 2 + 2 + 4.5 + 6.5 + 6.5, 2 + 4.5)
    assert h["tie_term"] == (27 - 3) + 2 * (8 - 2)


def test_symmetry(spark):
    rnd = random.Random(0)
    even = [rnd.gauss(0, 1) for _ in range(60)]
    skewed = [rnd.expovariate(1) ** 2 for _ in range(60)]
    rows = [("even", i, v) for i, v in enumerate(even)] + [("skewed", i, v) for i, v in enumerate(skewed)]
    rows += [("flat", i, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "h string, i int, d double")
    got = {r["h"]: r for r in stats.symmetry_test(df, KEYS, "i", replicates=300).collect()}
    assert got["even"]["symmetry_p"] > 0.05 > got["skewed"]["symmetry_p"]
    assert got["flat"]["symmetry_stat"] == 0.0 and got["flat"]["symmetry_p"] == 1.0
    median = sorted(even)[29:31]
    m = sum(median) / 2
    spread = math.sqrt(math.pi / 2) * sum(abs(v - m) for v in even) / 60
    assert got["even"]["symmetry_stat"] == pytest.approx(math.sqrt(60) * (sum(even) / 60 - m) / spread)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id int, p double")
    out = stats.holm_adjust(df, [], "p", F.col("id"), "adj").orderBy("id").collect()
    assert [r["adj"] for r in out] == pytest.approx([0.04, 0.09, 0.09, 0.5])
    capped = spark.createDataFrame([(1, 0.6), (2, 0.7)], "id int, p double")
    assert [r["adj"] for r in stats.holm_adjust(capped, [], "p", F.col("id"), "adj").orderBy("id").collect()] == [1.0, 1.0]


def test_winner(spark):
    df = spark.createDataFrame([(1, True, 0.6), (2, True, 0.4), (3, True, 0.5), (4, False, 0.9)], "id int, s boolean, e double")
    out = df.select("id", stats.winner(F.col("s"), F.col("e")).alias("w")).orderBy("id").collect()
    assert [r["w"] for r in out] == ["Treatment_better", "Baseline_better", "Tie", "No_diff"]


def test_missing_method(spark):
    df = spark.createDataFrame([("a", "T", 1.0)], "k string, method string, v double")
    with pytest.raises(KeyError, match="B"):
        stats.paired_values(df, ["k"], "method", "T", ["B"], ["v"])


def test_hypothesis_table(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(12):
        base = rnd.random()
        rows += [(f"k{i}", "T", base + 0.5 + rnd.random() / 10), (f"k{i}", "B", base), (f"k{i}", "C", base + 0.5 + rnd.random() / 10)]
    df = spark.createDataFrame(rows, "k string, method string, v double")
    table = stats.hypothesis_table(stats.compare_methods(df, ["k"], "method", "T", ["B", "C"], {"v": "higher"}, 50))
    got = {r["baseline"]: r for r in table.collect()}
    assert got["B"]["p_value"] == pytest.approx(2 / 2**12) and got["B"]["p_holm"] == pytest.approx(4 / 2**12)
    assert got["B"]["who_is_better"] == "Treatment_better" and got["B"]["n_pairs"] == 12
    assert got["C"]["who_is_better"] == "No_diff" and got["B"]["conclusion_robust"]


def run_table(spark):
    rows = [
        (1, "datasets/a.csv", "lr", "sex", 5, 5, 0.0, 0.5, "[]", 0.4, 0.1, 0.9, 1.0, None),
        (2, "datasets/a.csv", "lr", "sex", 5, 10, 0.5, 0.5, "[]", 0.4, 0.2, 0.8, 3.0, None),
        (3, "datasets/a.csv", "lr", "sex", 10, 10, 0.5, 0.5, "[]", 0.2, None, 0.7, 2.0, None),
        (4, "datasets/b.csv", "svc", "age", 10, 10, 0.5, 0.5, "[]", None, None, None, 9.0, None),
    ]
    return spark.createDataFrame(
        rows,
        "ord int, dataset string, model_identifier string, protected_attribute string, population_size int, generations int,"
        " alpha double, beta double, techniques string, fitness double, fairness_score double, performance_score double,"
        " elapsed_seconds double, error string",
    )


def test_summaries(spark):
    got = {r["population_size"]: r for r in analysis.summarize(run_table(spark), ["population_size"]).collect()}
    assert got[5]["n_runs"] == 2 and got[5]["fitness_std"] == 0.0 and got[5]["time_median"] == 2.0
    assert got[10]["n_runs"] == 1 and got[10]["fitness_std"] is None and got[10]["fairness_mean"] is None
    levels = analysis.summarize_levels(run_table(spark)).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in levels} == {"grid": 3, "population_size": 2, "generations": 2, "alpha": 2, "beta": 1}


def test_best_and_ties(spark):
    keys = ["dataset", "model_identifier", "protected_attribute"]
    best = analysis.best_per_group(run_table(spark), keys, "ord").orderBy("ord").collect()
    assert [r["ord"] for r in best] == [1, 4]
    assert sorted(r["ord"] for r in analysis.tied_best(run_table(spark), keys, "ord").collect()) == [1, 2]
    plan = analysis.best_per_group(run_table(spark), keys, "ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # pruned before and after the shuffle


def test_baseline_comparison(spark):
    base = spark.createDataFrame(
        [("a", "sex", "lr", "all", 0.1, 0.1, 0.1), ("a", "sex", "lr", "none", float("-inf"), float("inf"), 0.1)],
        "dataset string, protected_attribute string, model string, baseline string, fitness double, fairness double, performance double",
    )
    best = analysis.best_per_group(run_table(spark), ["dataset"], "ord")
    out = {r["dataset"]: r for r in analysis.best_vs_baseline(best, analysis.baseline_wide(base)).collect()}
    assert out["a"]["delta_fitness_none"] == float("inf") and out["a"]["better_than_both"]
    assert out["b"]["delta_fitness_all"] is None and out["b"]["better_than_all"] is False
    wins = analysis.win_summary(analysis.best_vs_baseline(best, analysis.baseline_wide(base))).first()
    assert (wins["total"], wins["both"], wins["both_share"]) == (2, 1, 0.5)


def test_box(spark):
    df = spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "i int, m string, v double")
    r = analysis.box_stats(df, ["m"], "v", "i").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (2, 3, 4, 1, 4, 1)


def test_signed_rank_method_is_explicit(spark):
    xs = [i + 1 if i % 3 else -(i + 1) for i in range(60)]
    pairs = pair_table(spark, {"h": (xs, [0] * 60)})
    rows = {m: stats.signed_rank_test(pairs, KEYS, m).first() for m in ("auto", "exact", "normal")}
    assert [rows[m]["p_method"] for m in ("auto", "exact", "normal")] == ["normal", "exact", "normal"]
    assert rows["exact"]["p_value"] != rows["normal"]["p_value"]
    assert abs(rows["exact"]["p_value"] - rows["normal"]["p_value"]) < 0.01
    with pytest.raises(ValueError):
        stats.signed_rank_test(pairs, KEYS, "other")


def test_hypotheses_are_named(spark):
    rows = spark.createDataFrame(
        [("m", "b", 0.01, 0.7, 0.9, 0.02), ("m", "c", 0.5, 0.5, 0.9, 0.6)],
        "metric string, baseline string, p_value double, a12_effective double, symmetry_p double, sign_p double",
    )
    table = stats.hypothesis_table(rows, labels={("m", "b"): "H1"})
    assert table.columns[0] == "hypothesis"
    assert {r["baseline"]: r["hypothesis"] for r in table.collect()} == {"b": "H1", "c": None}
