"""Reports over the table of runs: grouped summaries, best configurations, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.recode import path_stem
from evenkeel.operators.clean import pivot_mean
from evenkeel.operators.joins import attach, keyed_join
from evenkeel.operators.ordering import exact_quantiles
from evenkeel.roles import require_columns

#: Metric columns of a run and the prefixes their summaries use.
RUN_METRICS = {
    "fitness": "fitness",
    "fairness_score": "fairness",
    "performance_score": "perf",
    "elapsed_seconds": "time",
}
PARAMETERS = ["population_size", "generations", "alpha", "beta"]


def summarize(df: DataFrame, keys: list[str], metrics: dict[str, str] = RUN_METRICS) -> DataFrame:
    """Runs with a fitness, and mean, exact median and sample deviation of every metric.

    Each statistic skips its own NULLs; rows with a NULL key are dropped.
    """
    require_columns(df, [*keys, *metrics])
    return _summary(df.dropna(subset=keys), keys, metrics)


def _summary(rows: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """:func:`summarize` for keys that may be NULL by design (grouping levels)."""
    first = next(iter(metrics))
    basics = rows.groupBy(*keys).agg(
        F.count(first).alias("n_runs"),
        *[
            a
            for c, p in metrics.items()
            for a in (F.avg(c).alias(f"{p}_mean"), F.stddev_samp(c).alias(f"{p}_std"))
        ],
    )
    long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(
        keys, list(metrics), "__metric", "__v"
    )
    medians = (
        exact_quantiles(long, [*keys, "__metric"], "__v", {"m": 0.5})
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("__metric") == c, F.col("m"))).alias(f"{p}_median")
                for c, p in metrics.items()
            ]
        )
    )
    order = [f"{p}_{s}" for p in metrics.values() for s in ("mean", "median", "std")]
    return keyed_join(basics, medians, keys, "left").select(*keys, "n_runs", *order)


def summarize_levels(
    df: DataFrame, params: list[str] = PARAMETERS, metrics: dict[str, str] = RUN_METRICS
) -> DataFrame:
    """The full-grid summary and one summary per single parameter, from one expansion.

    ``level`` is 'grid' or the parameter's name; parameters not grouped by are NULL.
    """
    require_columns(df, [*params, *metrics])
    types = {f.name: f.dataType for f in df.schema.fields}

    def level(name: str, kept: list[str]) -> Column:
        whole = F.lit(True)
        for p in kept:
            whole = whole & F.col(p).isNotNull()
        cells = [
            (F.col(p) if p in kept else F.lit(None).cast(types[p])).alias(p) for p in params
        ]
        return F.when(whole, F.struct(F.lit(name).alias("level"), *cells))

    levels = F.array(level("grid", params), *[level(p, [p]) for p in params])
    expanded = (
        df.select(*metrics, F.explode(levels).alias("k"))
        .filter("k is not null")
        .select("k.*", *metrics)
    )
    return _summary(expanded, ["level", *params], metrics)


def best_per_group(
    df: DataFrame, keys: list[str], order: str, value: str = "fitness", n: int = 1
) -> DataFrame:
    """The ``n`` best rows per group by ``value``; ties go to the smallest ``order``.

    Rows with a NULL key are dropped. Spark prunes each task to its own ``n`` best rows
    per group before the shuffle, so a huge group is never moved whole.
    """
    require_columns(df, [*keys, order, value])
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(order))
    ranked = df.dropna(subset=keys).withColumn("__r", F.row_number().over(w))
    return ranked.filter(F.col("__r") <= n).drop("__r")


def tied_best(df: DataFrame, keys: list[str], row_id: str, value: str = "fitness") -> DataFrame:
    """All rows equal to their group's maximum."""
    tops = df.dropna(subset=keys).groupBy(*keys).agg(
        F.max(value).alias("__top"), F.count("*").alias("__n")
    )
    joined = attach(df, tops, keys, "__n", F.col(row_id))
    return joined.filter(F.col(value) == F.col("__top")).drop("__top", "__n")


def baseline_wide(baselines: DataFrame) -> DataFrame:
    """Static baselines side by side: one row per (dataset, attribute, model)."""
    keys = ["dataset", "protected_attribute", "model"]
    named = baselines.replace({"svm": "svc"}, subset=["model"]).dropna(subset=keys)
    return pivot_mean(
        named, keys, "baseline", ["all", "none"], ["fairness", "fitness", "performance"]
    )


def best_vs_baseline(best: DataFrame, wide: DataFrame) -> DataFrame:
    """Best runs with their static baselines, deltas and flags; unmatched runs stay."""
    rows = best.filter("error is null") if "error" in best.columns else best
    small = rows.select(
        path_stem(F.col("dataset")).alias("dataset"),
        "protected_attribute",
        F.col("model_identifier").alias("model"),
        *PARAMETERS,
        "techniques",
        F.col("fitness").cast("double").alias("best_fitness"),
        F.col("fairness_score").cast("double").alias("best_fairness"),
        F.col("performance_score").cast("double").alias("best_performance"),
    )
    return delta_flags(small.join(wide, ["dataset", "protected_attribute", "model"], "left"))


def delta_flags(merged: DataFrame) -> DataFrame:
    """Fitness gains over both baselines; a missing gain is not a win."""
    deltas = {
        f"delta_fitness_{b}": F.col("best_fitness") - F.col(f"fitness_{b}") for b in ("all", "none")
    }
    with_deltas = merged.withColumns(deltas)

    def better(b: str) -> Column:
        delta = F.col(f"delta_fitness_{b}")
        return F.coalesce((delta > 0) & ~F.isnan(delta), F.lit(False))

    return with_deltas.withColumns(
        {
            "better_than_all": better("all"),
            "better_than_none": better("none"),
            "better_than_both": better("all") & better("none"),
        }
    )


def win_summary(flags: DataFrame) -> DataFrame:
    """How many groups beat both baselines, or only one of them."""
    a, n = F.col("better_than_all"), F.col("better_than_none")
    counts = flags.agg(
        F.count("*").alias("total"),
        F.count_if(a & n).alias("both"),
        F.count_if(a & ~n).alias("only_all"),
        F.count_if(~a & n).alias("only_none"),
    )
    return counts.select(
        "*",
        *[
            F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")).alias(f"{c}_share")
            for c in ("both", "only_all", "only_none")
        ],
    )


def box_stats(df: DataFrame, keys: list[str], value: str, row_id: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and the number of outliers per group."""
    quartiles = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    bounds = keyed_join(quartiles, sizes, keys)
    rows = attach(df.filter(F.col(value).isNotNull()), bounds, keys, "n", F.col(row_id))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return rows.groupBy(*keys, "q1", "median", "q3", "n").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def param_curve(
    df: DataFrame, params: list[str] = PARAMETERS, value: str = "fitness"
) -> DataFrame:
    """Mean ``value`` by every value of every parameter, as (parameter, setting) rows."""
    long = df.select(
        *[F.col(p).cast("double").alias(p) for p in params], F.col(value).alias("__v")
    ).unpivot(["__v"], params, "parameter", "setting")
    return (
        long.filter("setting is not null")
        .groupBy("parameter", "setting")
        .agg(F.avg("__v").alias(f"{value}_mean"), F.count("__v").alias("n_runs"))
    )
