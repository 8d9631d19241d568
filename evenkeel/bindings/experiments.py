"""Queries for the reports over the table of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6
from evenkeel.bindings.views import CLEAN_RUNS, RUNS, STATIC, runs, static_scores
from evenkeel.operators import analysis
from evenkeel.operators.clean import clean_metrics

GROUP = ["dataset", "model_identifier", "protected_attribute"]
PREFIXES = list(analysis.RUN_METRICS.values())


def _clean(spark, d):
    return clean_metrics(runs(spark, d), list(analysis.RUN_METRICS))


def _summary_cols(keys):
    return [*keys, "n_runs", *[r6(f"{p}_{s}") for p in PREFIXES for s in ("mean", "median", "std")]]


def _shown(df, keep):
    """Best rows as comparable columns; the infinite fitness shows as NULL."""
    return df.select(*keep, F.when(F.abs("fitness") != float("inf"), F.col("fitness")).alias("fitness"))


def summary_by_group(spark, d):
    return analysis.summarize(_clean(spark, d), GROUP).select(*_summary_cols(GROUP))


def summary_by_parameters(spark, d):
    return analysis.summarize(_clean(spark, d), analysis.PARAMETERS).select(
        *_summary_cols(analysis.PARAMETERS)
    )


def summary_grouping_sets(spark, d):
    levels = analysis.summarize_levels(_clean(spark, d))
    return levels.select(*_summary_cols(["level", *analysis.PARAMETERS]))


def summary_top10(spark, d):
    s = analysis.summarize(_clean(spark, d), analysis.PARAMETERS)
    top = s.orderBy(F.col("fitness_mean").desc_nulls_last(), *analysis.PARAMETERS).limit(10)
    return top.select(*analysis.PARAMETERS, "n_runs", r6("fitness_mean"))


def best_per_group(spark, d):
    return _shown(analysis.best_per_group(runs(spark, d), GROUP, "ord"), [*GROUP, "ord"])


def best_three_per_group(spark, d):
    return _shown(analysis.best_per_group(runs(spark, d), GROUP, "ord", n=3), [*GROUP, "ord"])


def best_per_model(spark, d):
    return _shown(analysis.best_per_group(runs(spark, d), ["model_identifier"], "ord"), ["model_identifier", "ord"])


def best_per_pair(spark, d):
    keys = ["dataset", "protected_attribute"]
    return _shown(analysis.best_per_group(runs(spark, d), keys, "ord"), [*keys, "ord"])


def tied_best(spark, d):
    return _shown(analysis.tied_best(runs(spark, d), GROUP, "ord"), [*GROUP, "ord"])


def baseline_wide(spark, d):
    keys = ["dataset", "protected_attribute", "model"]
    wide = analysis.baseline_wide(static_scores(spark, d))
    return wide.select(*keys, *[r6(c) for c in wide.columns if c not in keys])


def _merged(spark, d):
    best = analysis.best_per_group(runs(spark, d), GROUP, "ord")
    return analysis.best_vs_baseline(best, analysis.baseline_wide(static_scores(spark, d)))


def best_vs_baseline(spark, d):
    m = _merged(spark, d)
    numbers = [f"{x}_{b}" for x in ("fitness", "fairness", "performance") for b in ("all", "none")]
    return m.select(
        "dataset", "protected_attribute", "model", *analysis.PARAMETERS, "techniques",
        r6("best_fitness"), r6("best_fairness"), r6("best_performance"), *[r6(c) for c in numbers],
    )


def delta_flags(spark, d):
    return _merged(spark, d).select(
        "dataset", "protected_attribute", "model", r6("delta_fitness_all"), r6("delta_fitness_none"),
        "better_than_all", "better_than_none", "better_than_both",
    )


def win_summary(spark, d):
    s = analysis.win_summary(_merged(spark, d))
    return s.select(*[r6(c) if c.endswith("share") else F.col(c) for c in s.columns])


def win_summary_runs(spark, d):
    """Every run, not only the best ones, against two fixed thresholds."""
    r = _clean(spark, d).select(
        F.col("fitness").alias("best_fitness"),
        F.col("fairness_score").alias("fitness_all"),
        F.col("performance_score").alias("fitness_none"),
    )
    s = analysis.win_summary(analysis.delta_flags(r))
    return s.select(*[r6(c) if c.endswith("share") else F.col(c) for c in s.columns])


def box_stats(spark, d):
    b = analysis.box_stats(_clean(spark, d), ["dataset"], "elapsed_seconds", "ord")
    return b.select("dataset", "n", "n_outliers", *[r6(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def param_curve(spark, d):
    return analysis.param_curve(_clean(spark, d)).select("parameter", "setting", "n_runs", r6("fitness_mean"))


QUERIES = {
    f.__name__: f
    for f in (
        summary_by_group, summary_by_parameters, summary_grouping_sets, summary_top10,
        best_per_group, best_three_per_group, best_per_model, best_per_pair, tied_best,
        baseline_wide, best_vs_baseline, delta_flags, win_summary, win_summary_runs, box_stats,
        param_curve,
    )
}

_COLS = {"fitness": "fitness", "fairness": "fairness_score", "perf": "performance_score", "time": "elapsed_seconds"}
_AGGS = "count(fitness) as n_runs, " + ", ".join(
    f"round(avg({c}), 6) as {p}_mean, round(quantile_cont({c}, 0.5), 6) as {p}_median, round(stddev_samp({c}), 6) as {p}_std"
    for p, c in _COLS.items()
)
_G = ", ".join(GROUP)
_P = ", ".join(analysis.PARAMETERS)


def _level(name: str, kept: list[str]) -> str:
    cols = ", ".join(
        p if p in kept else f"cast(null as {'double' if p in ('alpha', 'beta') else 'int'}) as {p}"
        for p in analysis.PARAMETERS
    )
    return f"select '{name}' as level, {cols}, {_AGGS} from clean group by {', '.join(kept)}"


def _best(keys: str, n: int = 1) -> str:
    return f"""with {RUNS}
select {keys}, ord, case when isfinite(fitness) then fitness end as fitness from runs
qualify row_number() over (partition by {keys} order by fitness desc nulls last, ord) <= {n}"""


_WIDE = """wide as (select dataset, protected_attribute, case when model = 'svm' then 'svc' else model end as model,
  """ + ", ".join(
    f"avg({m}) filter (baseline = '{b}') as {m}_{b}" for m in ("fairness", "fitness", "performance") for b in ("all", "none")
) + " from static_scores group by all)"

_MERGED = f"""{STATIC}, {_WIDE}, best as (
  select * from runs qualify row_number() over (partition by {_G} order by fitness desc nulls last, ord) = 1),
merged as (
  select regexp_extract(b.dataset, '([a-z_]+)\\.csv', 1) as dataset, b.protected_attribute, b.model_identifier as model,
    {', '.join('b.' + p for p in analysis.PARAMETERS)}, b.techniques, b.fitness as best_fitness, b.fairness_score as best_fairness,
    b.performance_score as best_performance, w.* exclude (dataset, protected_attribute, model),
    b.fitness - fitness_all as delta_fitness_all, b.fitness - fitness_none as delta_fitness_none
  from best b left join wide w on w.dataset = regexp_extract(b.dataset, '([a-z_]+)\\.csv', 1)
    and w.protected_attribute = b.protected_attribute and w.model = b.model_identifier
  where b.error is null),
flags as (select *, coalesce(delta_fitness_all > 0, false) as better_than_all, coalesce(delta_fitness_none > 0, false) as better_than_none from merged)"""

_WINS = """select count(*) as total, count(*) filter (a and n) as "both", count(*) filter (a and not n) as only_all, count(*) filter (not a and n) as only_none,
  round((count(*) filter (a and n)) / count(*), 6) as both_share, round((count(*) filter (a and not n)) / count(*), 6) as only_all_share,
  round((count(*) filter (not a and n)) / count(*), 6) as only_none_share"""

SQL = {
    "summary_by_group": f"with {CLEAN_RUNS} select {_G}, {_AGGS} from clean group by {_G}",
    "summary_by_parameters": f"with {CLEAN_RUNS} select {_P}, {_AGGS} from clean group by {_P}",
    "summary_grouping_sets": f"with {CLEAN_RUNS} "
    + " union all ".join([_level("grid", analysis.PARAMETERS), *[_level(p, [p]) for p in analysis.PARAMETERS]]),
    "summary_top10": f"""with {CLEAN_RUNS}, s as (select {_P}, count(fitness) as n_runs, avg(fitness) as m from clean group by {_P})
select {_P}, n_runs, round(m, 6) as fitness_mean from s order by m desc nulls last, {_P} limit 10""",
    "best_per_group": _best(_G),
    "best_three_per_group": _best(_G, 3),
    "best_per_model": _best("model_identifier"),
    "best_per_pair": _best("dataset, protected_attribute"),
    "tied_best": f"""with {RUNS}
select {_G}, ord, case when isfinite(fitness) then fitness end as fitness from runs
qualify fitness = max(fitness) over (partition by {_G})""",
    "baseline_wide": f"with {STATIC}, {_WIDE} select dataset, protected_attribute, model, "
    + ", ".join(f"round({m}_{b}, 6) as {m}_{b}" for m in ("fairness", "fitness", "performance") for b in ("all", "none"))
    + " from wide",
    "best_vs_baseline": f"""with {_MERGED} select dataset, protected_attribute, model, {_P}, techniques,
  round(best_fitness, 6) as best_fitness, round(best_fairness, 6) as best_fairness, round(best_performance, 6) as best_performance, """
    + ", ".join(f"round({m}_{b}, 6) as {m}_{b}" for m in ("fitness", "fairness", "performance") for b in ("all", "none"))
    + " from flags",
    "delta_flags": f"""with {_MERGED} select dataset, protected_attribute, model, round(delta_fitness_all, 6) + 0.0 as delta_fitness_all,
  round(delta_fitness_none, 6) + 0.0 as delta_fitness_none, better_than_all, better_than_none,
  better_than_all and better_than_none as better_than_both from flags""",
    "win_summary": f"with {_MERGED} {_WINS} from (select better_than_all as a, better_than_none as n from flags)",
    "win_summary_runs": f"""with {CLEAN_RUNS} {_WINS}
from (select coalesce(fitness - fairness_score > 0, false) as a, coalesce(fitness - performance_score > 0, false) as n from clean)""",
    "box_stats": f"""with {CLEAN_RUNS}, q as (select dataset, quantile_cont(elapsed_seconds, 0.25) as q1, quantile_cont(elapsed_seconds, 0.5) as median,
  quantile_cont(elapsed_seconds, 0.75) as q3, count(elapsed_seconds) as n from clean group by dataset),
r as (select *, elapsed_seconds between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from clean join q using (dataset))
select dataset, any_value(n) as n, count(*) filter (not inside) as n_outliers, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3, round(min(elapsed_seconds) filter (inside), 6) as whisker_low,
  round(max(elapsed_seconds) filter (inside), 6) as whisker_high from r group by dataset""",
    "param_curve": f"""with {CLEAN_RUNS}, l as (select fitness, unnest(['population_size', 'generations', 'alpha', 'beta']) as parameter,
  unnest([population_size::double, generations::double, alpha, beta]) as setting from clean)
select parameter, setting, count(fitness) as n_runs, round(avg(fitness), 6) as fitness_mean from l group by all""",
}
