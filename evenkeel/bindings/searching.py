"""Queries for the search over practice lists, one table for all runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.stores import ALL_SCORES, KEYS, MATCH, REQUESTS
from evenkeel.bindings.views import (
    NAMES_SQL,
    POPULATION,
    RUN_COLS,
    h_sql,
    search_runs,
    stored_text,
    table,
    u_sql,
)
from evenkeel.functions.arrays import crossover, mutate
from evenkeel.functions.hashing import hash32, uniform
from evenkeel.operators import search
from evenkeel.plans.grid import EVALUATED, run_grid, sample_evaluator
from evenkeel.roles import TECHNIQUES, Roles
from evenkeel.sources import scores


def _toy_score(population):
    """A fitness from the run's order of practices only: cheap, deterministic, with ties."""
    h = hash32("fit", "model", F.concat_ws(",", "techniques"))
    return population.withColumn(
        "fitness", F.when(h % 11 == 0, F.lit(float("-inf"))).otherwise((h % 1000) / F.lit(1000.0))
    )


def _flat(df, *columns):
    return df.select(*columns, F.concat_ws(",", "techniques").alias("techniques"))


def _parents(spark, d):
    scored = _toy_score(search.initial_population(search_runs(spark, d)))
    return search.select_parents(scored, RUN_COLS)


def ga_init(spark, d):
    return _flat(search.initial_population(search_runs(spark, d)), "run_id", "slot", "population_size")


def ga_score(spark, d):
    """Stored fitness of every individual; unknown lists stay without one."""
    store = scores.load_scores(stored_text(spark, d), "ord")
    population = search.initial_population(search_runs(spark, d))
    keyed = population.withColumn("__row", F.concat_ws(":", "run_id", "slot"))
    found = scores.score_lookup(keyed, store, None, "__row")
    return found.groupBy("model", "protected_attribute").agg(
        F.count("*").alias("n"),
        F.count("fitness").alias("n_known"),
        F.count_if(F.col("fitness") == float("-inf")).alias("n_infeasible"),
    )


def ga_select(spark, d):
    return _flat(search.parent_rows(_parents(spark, d)), "run_id", "rank", "slot")


def _pairs(spark, d):
    """Two given lists per customer: the first and the last individual of its run."""
    p = search.initial_population(search_runs(spark, d))
    return p.groupBy("run_id", "alpha", "beta").agg(
        F.min_by("techniques", "slot").alias("a"), F.max_by("techniques", "slot").alias("b")
    )


def ga_crossover(spark, d):
    child = crossover(
        F.col("a"), F.col("b"), uniform("x", "run_id") < F.col("alpha"), uniform("ca", "run_id"), uniform("cb", "run_id")
    )
    return _pairs(spark, d).select("run_id", F.concat_ws(",", child).alias("techniques"))


def ga_dedup(spark, d):
    both = F.array_distinct(F.concat("a", "b"))
    return _pairs(spark, d).select("run_id", F.concat_ws(",", both).alias("techniques"))


def ga_mutate(spark, d):
    child = mutate(
        F.col("a"), uniform("m", "run_id") < F.col("beta"), uniform("p", "run_id"), uniform("n", "run_id"), TECHNIQUES
    )
    return _pairs(spark, d).select("run_id", F.concat_ws(",", child).alias("techniques"))


def ga_generation(spark, d):
    return _flat(search.breed(_parents(spark, d), 0), "run_id", "slot", "generation")


def ga_search(spark, d):
    """Every customer's run, one to three generations each."""
    best = search.genetic_search(search_runs(spark, d), _toy_score)
    return best.select(
        "run_id",
        "generations",
        F.concat_ws(",", "techniques").alias("techniques"),
        F.when(F.abs("fitness") != float("inf"), F.col("fitness")).alias("fitness"),
    )


def run_grid_table(spark, d):
    """The same runs against the stored scores, as the table of finished runs."""
    store = scores.load_scores(stored_text(spark, d), "ord")
    rows = run_grid(search_runs(spark, d), store)
    return rows.groupBy("model_identifier", "protected_attribute").agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("fitness") > float("-inf")).alias("n_feasible"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
    )


def run_grid_evaluated(spark, d):
    """A search that trains: suppliers' balances by nation, an empty store, and one attribute that does not exist."""
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"),
        (F.col("s_nationkey") % 2).alias("sex"), (F.col("s_suppkey") % 60).alias("age"),
        (F.col("s_acctbal") + F.col("s_nationkey") % 2 * 2000 > 5000).cast("int").alias("target"),
    )
    samples = {("suppliers", a): (s, Roles("row_id", "target", a)) for a in ("sex", "missing")}
    nation = table(spark, d, "nation").where("n_regionkey = 0").select(
        F.col("n_nationkey").alias("run_id"), F.lit("suppliers").alias("dataset"), F.lit("lr").alias("model"),
        F.when(F.col("n_nationkey") % 4 == 0, "missing").otherwise("sex").alias("protected_attribute"),
        F.lit("target").alias("target_column"), F.lit(2).alias("population_size"), F.lit(1).alias("generations"),
        F.lit(0.5).alias("alpha"), F.lit(0.5).alias("beta"), F.lit(0.7).alias("perf_weight"), F.lit(0.3).alias("fair_weight"),
    )
    empty = spark.createDataFrame([], EVALUATED).drop("error")
    rows = run_grid(nation, empty, evaluate=sample_evaluator(samples))
    bad = F.col("error").isNotNull()
    return rows.groupBy("dataset", "model_identifier", "protected_attribute").agg(
        F.count("*").alias("n_runs"), F.count_if(bad).alias("n_error"),
        F.count_if(~bad & F.col("fitness").isNull()).alias("n_unscored"),
        F.count_if(F.col("elapsed_seconds") > 0).alias("n_timed"),
        F.count_if(bad & (F.col("fitness").isNotNull() | F.col("techniques").isNotNull())).alias("n_error_with_metrics"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        ga_init, ga_score, ga_select, ga_crossover, ga_dedup, ga_mutate, ga_generation, ga_search,
        run_grid_table, run_grid_evaluated,
    )
}


def _fit(text: str) -> str:
    h = h_sql("fit", "model", f"array_to_string({text}, ',')")
    return f"case when {h} % 11 = 0 then '-inf'::double else ({h} % 1000) / 1000.0::double end"


_PAIRS = """pairs as (select run_id, any_value(alpha) as alpha, any_value(beta) as beta, arg_min(techniques, slot) as a,
  arg_max(techniques, slot) as b from population group by run_id)"""


def _cross(a: str, b: str, hit: str, ua: str, ub: str) -> str:
    cut_a = f"(1 + floor({ua} * greatest(len({a}) - 1, 1)))::bigint"
    cut_b = f"(1 + floor({ub} * greatest(len({b}) - 1, 1)))::bigint"
    return f"case when {hit} then list_concat({a}[1:{cut_a}], {b}[({cut_b} + 1):]) else {a} end"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _mutate(c: str, hit: str, up: str, un: str) -> str:
    free = f"list_filter({NAMES_SQL}, lambda v: not list_contains({c}, v))"
    pos = f"(1 + floor({up} * len({c})))::bigint"
    new = f"({free})[(1 + floor({un} * len({free})))::bigint]"
    return f"case when {hit} and len({free}) > 0 then list_transform({c}, lambda v, i: case when i = {pos} then {new} else v end) else {c} end"


def _generation(source: str, g: int, out: str) -> str:
    """SQL of one scored generation's children, as table ``out``."""

    def u(p: str) -> str:
        return u_sql(f"42:{p}:{g}", "run_id", "slot")

    return f"""{source}_ranked as (select *, row_number() over (partition by run_id order by coalesce(fitness, '-inf'::double) desc, slot) as r from {source}),
{source}_par as (select run_id, list(techniques order by r) as ps from {source}_ranked where r <= greatest(1, population_size // 2) group by run_id),
{out}_u as (select s.* exclude (techniques, fitness), ps, len(ps) as np, floor({u('pa')} * len(ps))::bigint as i1,
    floor({u('pb')} * greatest(len(ps) - 1, 1))::bigint as i2 from {source} s join {source}_par using (run_id)),
{out}_p as (select *, ps[i1 + 1] as a, ps[(case when np = 1 then 0 when i2 >= i1 then i2 + 1 else i2 end) + 1] as b from {out}_u),
{out}_x as (select *, {_cross('a', 'b', f"{u('cross')} < alpha", u('cut_a'), u('cut_b'))} as x from {out}_p),
{out}_d as (select *, {_distinct('x')} as c from {out}_x),
{out} as (select * exclude (ps, np, i1, i2, a, b, x, c), {_mutate('c', f"{u('mutate')} < beta", u('position'), u('new'))} as techniques from {out}_d)"""


_SCORED = f"{POPULATION}, scored0 as (select *, {_fit('techniques')} as fitness from population)"
_GENERATIONS = (
    _SCORED
    + ", " + _generation("scored0", 0, "pop1") + f", scored1 as (select *, {_fit('techniques')} as fitness from pop1)"
    + ", " + _generation("scored1", 1, "pop2") + f", scored2 as (select *, {_fit('techniques')} as fitness from pop2)"
)


def _stored(population: str) -> str:
    keys = " and ".join(f"s.{k} = q.{k}" for k in KEYS)
    return f"""(select q.*, s.fitness from {population} q left join loaded s
  on {keys} and s.techniques = array_to_string(q.techniques, ','))"""


_STORE_GENERATIONS = (
    f"{POPULATION}, {ALL_SCORES}, stored0 as {_stored('population')}"
    + ", " + _generation("stored0", 0, "next1") + f", stored1 as {_stored('next1')}"
    + ", " + _generation("stored1", 1, "next2") + f", stored2 as {_stored('next2')}"
)

SQL = {
    "ga_init": f"with {POPULATION} select run_id, slot, population_size, array_to_string(techniques, ',') as techniques from population",
    "ga_select": f"""with {_SCORED}, r as (select *, row_number() over (partition by run_id order by fitness desc, slot) as rank from scored0)
select run_id, rank::int as rank, slot, array_to_string(techniques, ',') as techniques from r where rank <= greatest(1, population_size // 2)""",
    "ga_crossover": f"""with {POPULATION}, {_PAIRS}
select run_id, array_to_string({_cross('a', 'b', u_sql('x', 'run_id') + ' < alpha', u_sql('ca', 'run_id'), u_sql('cb', 'run_id'))}, ',') as techniques from pairs""",
    "ga_dedup": f"""with {POPULATION}, {_PAIRS}, c as (select run_id, list_concat(a, b) as x from pairs)
select run_id, array_to_string({_distinct('x')}, ',') as techniques from c""",
    "ga_mutate": f"""with {POPULATION}, {_PAIRS}
select run_id, array_to_string({_mutate('a', u_sql('m', 'run_id') + ' < beta', u_sql('p', 'run_id'), u_sql('n', 'run_id'))}, ',') as techniques from pairs""",
    "ga_generation": f"""with {_SCORED}, {_generation('scored0', 0, 'pop1')}
select run_id, slot, 1 as generation, array_to_string(techniques, ',') as techniques from pop1""",
    "ga_search": f"""with {_GENERATIONS}, last as (
  select run_id, generations, slot, techniques, fitness from scored0 where generations = 1 union all
  select run_id, generations, slot, techniques, fitness from scored1 where generations = 2 union all
  select run_id, generations, slot, techniques, fitness from scored2 where generations = 3)
select run_id, generations, array_to_string(techniques, ',') as techniques, case when isfinite(fitness) then fitness end as fitness
from last qualify row_number() over (partition by run_id order by fitness desc, slot) = 1""",
    "ga_score": f"""with {REQUESTS}, {ALL_SCORES}
select q.model, q.protected_attribute, count(*) as n, count(s.fitness) as n_known, count(*) filter (isinf(s.fitness)) as n_infeasible
from requests q left join loaded s on {MATCH.format('s')} group by all""",
    "run_grid_table": f"""with {_STORE_GENERATIONS}, last as (
  select * from stored0 where generations = 1 union all by name select * from stored1 where generations = 2
  union all by name select * from stored2 where generations = 3),
best as (select * from last qualify row_number() over (partition by run_id order by coalesce(fitness, '-inf'::double) desc, slot) = 1)
select model as model_identifier, protected_attribute, count(*) as n_runs, count(*) filter (fitness > '-inf'::double) as n_feasible,
  0::bigint as n_error from best group by all""",
    "run_grid_evaluated": """select 'suppliers' as dataset, 'lr' as model_identifier,
  case when n_nationkey % 4 = 0 then 'missing' else 'sex' end as protected_attribute, count(*) as n_runs,
  count(*) filter (n_nationkey % 4 = 0) as n_error, 0::bigint as n_unscored, count(*) as n_timed, 0::bigint as n_error_with_metrics
  from nation where n_regionkey = 0 group by all""",
}
