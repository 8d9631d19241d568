"""Performance and fairness of predictions, for all runs and folds in one grouped pass.

The predictions table has one row per (run keys..., fold, row) with ``y`` (0/1 label),
``s`` (1 = privileged), ``pred`` (0/1) and ``score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.ratios import INF, rate, ratio
from evenkeel.operators.joins import attach, keyed_join
from evenkeel.operators.lineage import cut_lineage
from evenkeel.operators.ordering import prefix_sums, value_cells
from evenkeel.roles import FAIRNESS_WHEN_UNDEFINED, INFEASIBLE

METRICS = ["statistical_parity", "equal_opportunity", "disparate_impact"]


def group_rates(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per run, fold and group: n, n_pos, n_pred_pos, n_tp."""
    return preds.groupBy(*keys, "s").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("pred") == 1).alias("n_pred_pos"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("n_tp"),
    )


def contingency(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions equal in (keys, score, y, s, pred) as one row with their number ``n``: all that the metrics need."""
    return preds.groupBy(*keys, "score", "y", "s", "pred").agg(F.count("*").alias("n"))


def _tally(cond: Column, n: str | None) -> Column:
    """Rows where ``cond`` holds; of a contingency table, the rows it stands for."""
    return F.count_if(cond) if n is None else F.sum(F.when(cond, F.col(n)).otherwise(0))


def _gap_counts(n: str | None) -> list[Column]:
    """Counts by group that the gaps follow from."""
    counts = []
    for g in (0, 1):
        own, positive, chosen = F.col("s") == g, F.col("y") == 1, F.col("pred") == 1
        for name, cond in (("n", own), ("pp", own & chosen), ("p", own & positive), ("tp", own & positive & chosen)):
            counts.append(_tally(cond, n).alias(f"{name}{g}"))
    missing = F.col("s").isNull() | F.col("y").isNull() | F.col("pred").isNull()
    return [*counts, _tally(missing, n).alias("n_missing")]


def _gaps() -> list[Column]:
    """The three absolute gaps from the columns of :func:`_gap_counts`."""
    r0, r1 = rate(F.col("pp0"), F.col("n0")), rate(F.col("pp1"), F.col("n1"))
    t0, t1 = rate(F.col("tp0"), F.col("p0")), rate(F.col("tp1"), F.col("p1"))
    whole = F.col("n_missing") == 0
    return [
        F.when(whole, F.abs(r0 - r1)).alias("statistical_parity"),
        F.when(whole, F.abs(t0 - t1)).alias("equal_opportunity"),
        F.when(whole, F.abs(1 - ratio(r0, r1))).alias("disparate_impact"),
    ]


def fairness(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute parity, opportunity and impact gaps of every (keys) group.

    NULL is undefined (an empty group, 0/0, or labels, groups or predictions missing);
    infinity is an unbounded impact ratio.
    """
    return preds.groupBy(*keys).agg(*_gap_counts(None)).select(*keys, *_gaps())


def fold_sum() -> Column:
    """Sum of the three gaps: undefined wins over unbounded, unbounded over finite."""
    return F.col(METRICS[0]) + F.col(METRICS[1]) + F.col(METRICS[2])


def average_precision(preds: DataFrame, keys: list[str], n: str | None = None) -> DataFrame:
    """Sum of (recall step x precision) over distinct scores, best first, per group.

    NULL without positives. Scores are collapsed to counts before anything is ordered. With ``n``, ``preds`` is a
    contingency table with that column of counts.
    """
    counts = preds.groupBy(*keys, "score").agg(
        _tally(F.lit(True), n).alias("n"), _tally(F.col("y") == 1, n).alias("pos")
    )
    placed = prefix_sums(counts, keys, "score", ["n", "pos"], value_cells(preds, "score"))
    at_least = F.col("total_n") - F.col("before_n")
    hits = F.col("total_pos") - F.col("before_pos")
    step = rate(F.col("pos"), F.col("total_pos")) * rate(hits, at_least)
    return placed.groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def _label_columns(n: str | None) -> list[Column]:
    """Smallest and largest label, and the accuracy."""
    right = F.col("pred") == F.col("y")
    accuracy = F.avg(right.cast("double")) if n is None else rate(_tally(right, n), _tally(right.isNotNull(), n))
    return [F.min("y").alias("__lo"), F.max("y").alias("__hi"), accuracy.alias("__acc")]


def _performance_columns() -> list[Column]:
    one_class = F.col("__lo") == F.col("__hi")
    return [
        F.when(one_class, F.col("__acc")).otherwise(F.col("average_precision")).alias("performance"),
        F.coalesce(one_class, F.lit(True)).alias("used_accuracy"),
    ]


def performance(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision; plain accuracy where a group's labels are of one class only."""
    plain = preds.groupBy(*keys).agg(*_label_columns(None))
    both = keyed_join(plain, average_precision(preds, keys), keys, "left")
    return both.select(*keys, *_performance_columns())


def fold_report(preds: DataFrame, keys: list[str]) -> DataFrame:
    """``performance``, ``used_accuracy`` and the three gaps of every (keys) group, from one pass over the predictions.

    The contingency table is written to the checkpoint folder; accuracy, gaps and average precision follow from it.
    """
    table = cut_lineage(contingency(preds, keys))
    plain = table.groupBy(*keys).agg(*_label_columns("n"), *_gap_counts("n"))
    both = keyed_join(plain, average_precision(table, keys, "n"), keys, "left")
    return both.select(*keys, *_performance_columns(), *_gaps())


def score_minmax(df: DataFrame, raw: str, keys: list[str], row_id: str, out: str = "score") -> DataFrame:
    """Scale decision values to [0, 1] within each group (test fold)."""
    span = df.groupBy(*keys).agg(
        F.min(raw).alias("__lo"), F.max(raw).alias("__hi"), F.count("*").alias("__n")
    )
    joined = attach(df, span, keys, "__n", F.col(row_id))
    value = (F.col(raw) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-12))
    return joined.withColumn(out, value).drop("__lo", "__hi", "__n")


def hard_label(df: DataFrame, score: str = "score", out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= 0.5).cast("int"))


def any_unbounded(col: Column) -> Column:
    return F.coalesce(F.bool_or(col == INF), F.lit(False))


def combined_fitness(
    folds: DataFrame, keys: list[str], perf_weight: float = 0.5, fair_weight: float = 0.5
) -> DataFrame:
    """One row per run from its folds (columns ``performance`` and the three gaps).

    Undefined folds are left out of the fairness mean. Without any defined fold, or with an
    unbounded one, the run is infeasible: fitness -infinity.
    """
    scored = folds.withColumn("__f", fold_sum())
    runs = scored.groupBy(*keys).agg(
        F.avg("performance").alias("performance_score"),
        F.avg("__f").alias("__mean"),
        any_unbounded(F.col("__f")).alias("__unbounded"),
        F.count("*").alias("n_folds"),
        F.count("__f").alias("n_defined"),
    )
    fair = F.when(F.col("__unbounded"), F.lit(INF)).otherwise(F.col("__mean") / 3)
    value = F.lit(perf_weight) * F.col("performance_score") - F.lit(fair_weight) * (
        F.col("__mean") / 3
    )
    infeasible = F.col("__unbounded") | F.col("__mean").isNull()
    return runs.select(
        *keys,
        F.when(infeasible, F.lit(INFEASIBLE)).otherwise(value).alias("fitness"),
        fair.alias("fairness_score"),
        "performance_score",
        "n_folds",
        "n_defined",
    )


def metric_fold_means(folds: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Mean of each metric over its defined folds; unbounded if any fold is."""
    return folds.groupBy(*keys).agg(
        *[
            F.when(any_unbounded(F.col(m)), F.lit(INF)).otherwise(F.avg(m)).alias(m)
            for m in metrics
        ]
    )


def baseline_fairness(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the three per-metric fold means, or the worst value where undefined."""
    means = metric_fold_means(folds, keys)
    bad_fold = F.coalesce(F.abs(fold_sum()) == INF, F.lit(True))
    bad = folds.groupBy(*keys).agg(F.count_if(bad_fold).alias("undefined_fairness_folds"))
    undefined = F.coalesce(fold_sum() == INF, F.lit(True))
    return keyed_join(means, bad, keys).select(
        *keys,
        F.when(undefined, F.lit(FAIRNESS_WHEN_UNDEFINED))
        .otherwise(fold_sum() / 3)
        .alias("fairness_score"),
        "undefined_fairness_folds",
        undefined.alias("fairness_undefined"),
    )


def fairness_report(
    preds: DataFrame, keys: list[str], perf_weight: float = 0.5, fair_weight: float = 0.5
) -> DataFrame:
    """Fitness, fairness and performance of every run, from predictions with a ``fold``."""
    return combined_fitness(fold_report(preds, [*keys, "fold"]), keys, perf_weight, fair_weight)
