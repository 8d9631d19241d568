"""Queries for result tables, the score store, the catalogue and the run grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.views import (
    POPULATION,
    RUNS,
    STORE_TEXT,
    runs,
    search_runs,
    stored_text,
)
from evenkeel.operators.search import initial_population
from evenkeel.sources import catalogue, results, scores

KEYS = ["dataset", "model", "protected_attribute", "target_column"]


def _text(df):
    """Stored scores as comparable columns: lists as text, infeasible as a flag."""
    return df.drop(*scores.WEIGHTS).withColumns(
        {
            "techniques": F.concat_ws(",", "techniques"),
            "infeasible": F.coalesce(F.col("fitness") == float("-inf"), F.lit(False)),
            "fitness": F.when(F.abs("fitness") != float("inf"), F.col("fitness")),
        }
    )


def _result_rows(spark, d):
    return results.result_rows(runs(spark, d))


def result_rows(spark, d):
    """Fixed columns of finished and failed runs; failed runs have no outcome."""
    return _result_rows(spark, d).withColumn(
        "fitness", F.when(F.abs("fitness") != float("inf"), F.col("fitness"))
    )


def split_ok_err(spark, d):
    good, bad = results.split_results(_result_rows(spark, d))
    return good.groupBy("dataset").agg(
        F.count("*").alias("n"), F.lit("success").alias("kind"), F.count("model_used").alias("n_model_used")
    ).unionByName(
        bad.groupBy("dataset").agg(
            F.count("*").alias("n"), F.lit("error").alias("kind"), F.count("model_used").alias("n_model_used")
        )
    )


def count_results(spark, d):
    return results.count_results(_result_rows(spark, d))


def validate_output(spark, d):
    return results.validate_output(*results.split_results(_result_rows(spark, d)))


def score_store_load(spark, d):
    return _text(scores.load_scores(stored_text(spark, d), "ord"))


def score_store_append(spark, d):
    """Stored scores written back to text rows: practices as JSON, missing scores as ''."""
    loaded = scores.load_scores(stored_text(spark, d), "ord")
    rows = scores.store_rows(loaded, F.lit("0"))
    return rows.select(
        "timestamp", *KEYS, "techniques", "extra",
        *[(F.col(s) == "").alias(f"{s}_missing") for s in scores.SCORES],
        (F.col("fitness") == "-Infinity").alias("infeasible"),
    )


def _halves(spark, d):
    """Two stores: even orders are this session's, odd ones the archive."""
    raw = stored_text(spark, d)
    session = scores.load_scores(raw.filter("ord % 4 < 2"), "ord")
    return session, scores.load_scores(raw.filter("ord % 4 >= 2"), "ord")


def _requests(spark, d):
    return initial_population(search_runs(spark, d)).withColumn("__row", F.concat_ws(":", "run_id", "slot"))


def score_lookup(spark, d):
    session, archive = _halves(spark, d)
    found = scores.score_lookup(_requests(spark, d), session, archive, "__row")
    return _text(found).select("run_id", "slot", "techniques", "fitness", "infeasible", "fairness", "performance")


def score_lookup_reset(spark, d):
    session, _ = _halves(spark, d)
    found = scores.score_lookup(_requests(spark, d), session, None, "__row")
    return _text(found).select("run_id", "slot", "techniques", "fitness", "infeasible")


def score_misses(spark, d):
    missing = scores.score_misses(_requests(spark, d), list(_halves(spark, d)))
    return missing.select(*KEYS, F.concat_ws(",", "techniques").alias("techniques"))


def catalog_join(spark, d):
    """Runs matched to a catalogue that knows three of the five dataset paths."""
    known = [
        (n, f"datasets/{n}.csv", "income", ["sex", "age"], "y") for n in ("click", "purchase", "view")
    ]
    cat = catalogue.catalogue(spark, known)
    joined = catalogue.join_catalogue(runs(spark, d), cat)
    return joined.select("ord", "name", "target", F.concat_ws(",", "protected_attributes").alias("attributes"))


def grid_enumerate(spark, d):
    """The study grid for every customer segment that occurs, one attribute kept."""
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("name")).distinct()
    datasets = names.select(
        "name", F.lit("y").alias("target"), F.array(F.lit("sex"), F.lit("age")).alias("protected_attributes")
    )
    return catalogue.build_tasks(datasets, protected=["age"])


def grid_counts(spark, d):
    """Grid points per dataset and attribute, all attributes kept."""
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("name")).distinct()
    datasets = names.select(
        "name", F.lit("y").alias("target"), F.array(F.lit("sex"), F.lit("age")).alias("protected_attributes")
    )
    return catalogue.build_tasks(datasets).groupBy("dataset", "protected_attribute").agg(
        F.count("*").alias("n"), F.round(F.avg("alpha"), 6).alias("mean_alpha")
    )


QUERIES = {
    f.__name__: f
    for f in (
        result_rows, split_ok_err, count_results, validate_output, score_store_load,
        score_store_append, score_lookup, score_lookup_reset, score_misses, catalog_join,
        grid_enumerate, grid_counts,
    )
}


def _store(name: str, where: str) -> str:
    return f"""{name}_last as (
  select dataset, model, protected_attribute, target_column, coalesce(nullif(techniques, ''), '[]') as j, max(ord) as last
  from stored_text where {where} group by all),
{name} as (
  select s.dataset, s.model, s.protected_attribute, s.target_column,
    replace(replace(replace(j, '[', ''), ']', ''), '"', '') as techniques, j,
    case when t.fitness = 'NaN' then '-inf'::double else nullif(t.fitness, '')::double end as fitness,
    nullif(t.fairness, '')::double as fairness, nullif(t.performance, '')::double as performance
  from {name}_last s join stored_text t on s.last = t.ord)"""


ALL_SCORES = f"{STORE_TEXT}, {_store('loaded', 'true')}"
_HALVES = f"{STORE_TEXT}, {_store('session', 'ord % 4 < 2')}, {_store('archive', 'ord % 4 >= 2')}"
_FIT = "case when not isinf({0}) then {0} end as fitness, coalesce(isinf({0}), false) as infeasible"
REQUESTS = POPULATION + ", requests as (select * replace (array_to_string(techniques, ',') as techniques) from population)"
MATCH = " and ".join(f"{{0}}.{k} = q.{k}" for k in [*KEYS, "techniques"])

_GRID = """select m as dataset, 'y' as target, protected_attribute, population_size, generations, alpha, beta, model
from (select distinct c_mktsegment as m from customer), (select unnest({0}) as protected_attribute),
  (select unnest([5,10,15,20,50,100]) as population_size), (select unnest([5,10,15,20,50,100]) as generations),
  (select unnest([0,0.25,0.5,0.75,1]::double[]) as alpha), (select unnest([0,0.25,0.5,0.75,1]::double[]) as beta),
  (select unnest(['rf','lr','svc','xgb']) as model)"""

SQL = {
    "result_rows": f"""with {RUNS} select * exclude (ord) replace (case when isfinite(fitness) then fitness end as fitness,
  case when error is null then techniques end as techniques) from runs""",
    "split_ok_err": f"""with {RUNS}
select dataset, count(*) as n, case when error is null then 'success' else 'error' end as kind, count(model_used) as n_model_used
from runs group by all""",
    "count_results": f"with {RUNS} select count(*) filter (error is null) as n_success, count(error) as n_error from runs",
    "validate_output": f"""with {RUNS} select count(*) filter (error is null) as n_rows, 13::bigint as n_cols, count(error) as n_err,
  count(*) filter (error is null) >= 1 as ok from runs""",
    "score_store_load": f"""with {ALL_SCORES} select dataset, model, protected_attribute, target_column, techniques, {_FIT.format('fitness')},
  fairness, performance from loaded""",
    "score_store_append": f"""with {ALL_SCORES} select '0' as timestamp, dataset, model, protected_attribute, target_column, j as techniques, '' as extra,
  fitness is null as fitness_missing, fairness is null as fairness_missing, performance is null as performance_missing,
  coalesce(isinf(fitness), false) as infeasible from loaded""",
    "score_lookup": f"""with {REQUESTS}, {_HALVES}, f as (
  select run_id, slot, q.techniques, case when s.fitness is not null then s.fitness else a.fitness end as fit,
    case when s.fitness is not null then s.fairness when a.fitness is not null then a.fairness end as fairness,
    case when s.fitness is not null then s.performance when a.fitness is not null then a.performance end as performance
  from requests q left join session s on {MATCH.format('s')} left join archive a on {MATCH.format('a')})
select run_id, slot, techniques, {_FIT.format('fit')}, fairness, performance from f""",
    "score_lookup_reset": f"""with {REQUESTS}, {_HALVES}
select run_id, slot, q.techniques, {_FIT.format('s.fitness')} from requests q left join session s on {MATCH.format('s')}""",
    "score_misses": f"""with {REQUESTS}, {_HALVES}
select distinct q.dataset, q.model, q.protected_attribute, q.target_column, q.techniques from requests q
where not exists (select 1 from session s where fitness is not null and {MATCH.format('s')})
  and not exists (select 1 from archive a where fitness is not null and {MATCH.format('a')})""",
    "catalog_join": f"""with {RUNS}
select ord, n as name, 'y' as target, 'sex,age' as attributes from runs join (select unnest(['click', 'purchase', 'view']) as n)
  on dataset = 'datasets/' || n || '.csv'""",
    "grid_enumerate": _GRID.format("['age']"),
    "grid_counts": f"""with g as ({_GRID.format("['sex','age']")})
select dataset, protected_attribute, count(*) as n, round(avg(alpha), 6) as mean_alpha from g group by all""",
}
