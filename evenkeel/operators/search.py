"""Search over ordered practice lists: all runs evolve in lock-step as one table.

Population rows carry their run's columns (``run_id``, ``population_size``, ``alpha``,
``beta`` and any others), ``slot`` and ``techniques``. A run's population is bounded by
its ``population_size``, so collecting one run's parents into an array is bounded too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.arrays import crossover, draw_index, mutate, name_array, random_subset
from evenkeel.functions.hashing import uniform
from evenkeel.operators.lineage import cut_lineage
from evenkeel.roles import INFEASIBLE, TECHNIQUES

SEED = "42"
#: Individuals made by one task.
TASK_ROWS = 20_000


def initial_population(
    runs: DataFrame, names: list[str] = TECHNIQUES, seed: str = SEED
) -> DataFrame:
    """Slots 1..population_size per run, each a random ordered subset of the practices.

    The runs are dealt by ``run_id`` over tasks of about ``TASK_ROWS`` individuals before they multiply, however few
    files or blocks they are read from; what is grouped by run afterwards stays in its task.
    """
    slots = F.sequence(F.lit(1), F.col("population_size").cast("int"))
    total = runs.agg(F.sum("population_size").alias("n")).first()["n"] or 0
    return (
        runs.repartition(max(1, math.ceil(total / TASK_ROWS)), "run_id")
        .withColumn("slot", F.explode(slots))
        .withColumn("generation", F.lit(0))
        .withColumn("techniques", random_subset(names, f"{seed}:init", "run_id", "slot"))
    )


def n_parents() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("population_size") / 2).cast("int"))


def select_parents(scored: DataFrame, run_cols: list[str]) -> DataFrame:
    """Per run the best half (at least one) as an array, best first; ties by slot."""
    worst_first = -F.coalesce(F.col("fitness"), F.lit(INFEASIBLE))
    entry = F.struct(worst_first.alias("o"), "slot", "techniques")
    ranked = scored.groupBy(*run_cols).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    return ranked.withColumn(
        "parents", F.slice("__all", F.lit(1), n_parents())
    ).drop("__all")


def parent_rows(parents: DataFrame) -> DataFrame:
    """One row per selected parent with its 1-based rank."""
    cols = [c for c in parents.columns if c != "parents"]
    return parents.select(*cols, F.posexplode("parents").alias("rank", "p")).select(
        *cols, (F.col("rank") + 1).alias("rank"), F.col("p.slot").alias("slot"), "p.techniques"
    )


def breed(
    parents: DataFrame, generation: int, names: list[str] = TECHNIQUES, seed: str = SEED
) -> DataFrame:
    """The next population: two distinct parents, crossover, ordered dedup, mutation."""

    def u(purpose: str) -> Column:
        return uniform(f"{seed}:{purpose}:{generation}", "run_id", "slot")

    cols = [c for c in parents.columns if c != "parents"]
    slots = F.sequence(F.lit(1), F.col("population_size").cast("int"))
    pool = parents.withColumn("slot", F.explode(slots)).withColumn("__n", F.size("parents"))
    first = draw_index(u("pa"), F.col("__n"))
    other = draw_index(u("pb"), F.greatest(F.col("__n") - 1, F.lit(1)))
    second = F.when(F.col("__n") == 1, F.lit(0)).otherwise(
        F.when(other >= first, other + 1).otherwise(other)
    )
    paired = pool.select(
        *cols,
        "slot",
        F.get("parents", first)["techniques"].alias("a"),
        F.get("parents", second)["techniques"].alias("b"),
    )
    crossed = F.array_distinct(
        crossover(F.col("a"), F.col("b"), u("cross") < F.col("alpha"), u("cut_a"), u("cut_b"))
    )
    child = paired.withColumn("__child", crossed)
    one = F.array(F.get(name_array(names), draw_index(u("refill"), F.lit(len(names)))))
    filled = child.withColumn(
        "__child", F.when(F.size("__child") == 0, one).otherwise(F.col("__child"))
    )
    mutated = mutate(
        F.col("__child"), u("mutate") < F.col("beta"), u("position"), u("new"), names
    )
    return filled.select(
        *cols,
        "slot",
        F.lit(generation + 1).alias("generation"),
        mutated.alias("techniques"),
    )


def best_of(scored: DataFrame, run_cols: list[str]) -> DataFrame:
    """Per run the first individual of highest fitness."""
    kept = [c for c in ("techniques", "fitness", "fairness", "performance") if c in scored.columns]
    rank = F.struct(F.coalesce(F.col("fitness"), F.lit(INFEASIBLE)), -F.col("slot"))
    return scored.groupBy(*run_cols).agg(F.max_by(F.struct(*kept), rank).alias("b")).select(
        *run_cols, "b.*"
    )


def genetic_search(
    runs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    names: list[str] = TECHNIQUES,
    seed: str = SEED,
) -> DataFrame:
    """Evolve every run for its own number of ``generations``; one row per run.

    ``score`` adds ``fitness`` (and optionally ``fairness``, ``performance``) to a
    population. The answer of a run is the best of its last scored generation. Each
    generation is checkpointed, so plans stay short and lost executors cost one step.
    """
    if "model" in runs.columns and runs.filter("model is null").limit(1).count():
        raise ValueError("every run needs a model")
    span = runs.agg(F.min("generations").alias("lo"), F.max("generations").alias("hi")).first()
    if span["lo"] is None or span["lo"] < 1:
        raise ValueError("every run needs at least one generation")
    run_cols = runs.columns
    population = initial_population(runs, names, seed)
    finished = None
    for g in range(span["hi"]):
        population = population.persist(StorageLevel.MEMORY_AND_DISK)  # a look-up reads it for its keys and for its rows
        scored = cut_lineage(score(population))
        population.unpersist()
        done = best_of(scored.filter(F.col("generations") == g + 1), run_cols)
        finished = done if finished is None else finished.unionByName(done)
        going = scored.filter(F.col("generations") > g + 1)
        population = breed(select_parents(going, run_cols), g, names, seed)
    return finished
