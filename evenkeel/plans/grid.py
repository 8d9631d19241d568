"""Whole experiments: static baselines, the run grid, the comparison of methods."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.ratios import is_finite
from evenkeel.operators.lineage import cut_lineage, ensure_checkpoint_dir
from evenkeel.operators.metrics import combined_fitness, fold_report
from evenkeel.operators.search import genetic_search
from evenkeel.plans.evaluate import baseline_runs, evaluate_lists, predict_lists, score_baselines, union_all
from evenkeel.roles import INFEASIBLE, TECHNIQUES, Roles
from evenkeel.sources.results import result_rows
from evenkeel.sources.scores import SCORE_KEYS, append_scores, score_lookup, score_misses, with_weights

# Display label and name of the mitigation methods.
MITIGATIONS = {"FairSMOTE": "fairsmote", "Reweighing": "reweighing", "DIR": "dir"}

#: Failures of one run that become its error row; anything else stops the job.
RUN_ERRORS = (ArithmeticError, ValueError, KeyError, OSError, AnalysisException)

#: Keys (a practice list and a model) of one block of the evaluation queue.
BLOCK = 32

EVALUATED = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("protected_attribute", T.StringType()),
        T.StructField("target_column", T.StringType()),
        T.StructField("techniques", T.ArrayType(T.StringType())),
        T.StructField("perf_weight", T.DoubleType()),
        T.StructField("fair_weight", T.DoubleType()),
        T.StructField("fitness", T.DoubleType()),
        T.StructField("fairness", T.DoubleType()),
        T.StructField("performance", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def static_baselines(
    samples: dict[tuple[str, str], tuple[DataFrame, Roles]], models: list[str]
) -> DataFrame:
    """All practices in catalogue order, and none, for every (dataset, attribute) and model."""
    parts = []
    lists = {"all": TECHNIQUES, "none": []}
    for (dataset, attribute), (df, roles) in samples.items():
        scored = evaluate_lists(df, lists.values(), models, roles)
        label = F.when(F.col("techniques") == "", "none").otherwise("all")
        parts.append(
            scored.select(
                F.lit(dataset).alias("dataset"),
                F.lit(attribute).alias("protected_attribute"),
                "model",
                label.alias("baseline"),
                "techniques",
                "fitness",
                F.col("fairness_score").alias("fairness"),
                F.col("performance_score").alias("performance"),
            )
        )
    return union_all(parts)


def sample_evaluator(
    samples: dict[tuple[str, str], tuple[DataFrame, Roles]]
) -> Callable[[DataFrame], DataFrame]:
    """Evaluates a block of distinct practice lists on the sample of their (dataset, attribute).

    Lists of a block share the tables of their common beginnings, the models of a list share its folds, and all
    predictions of the block are scored in one pass. A list that fails counts as infeasible and carries ``type: message``.
    """

    def evaluate(missing: DataFrame) -> DataFrame:
        spark = missing.sparkSession
        todo = missing.select(*SCORE_KEYS).collect()  # a block
        wanted: dict[tuple[str, str], dict[tuple[str, ...], set[str]]] = {}
        for row in todo:
            lists = wanted.setdefault((row["dataset"], row["protected_attribute"]), {})
            lists.setdefault(tuple(row["techniques"]), set()).add(row["model"])
        done: dict[tuple, DataFrame | Exception | None] = {}
        for sample, lists in wanted.items():
            if sample in samples:
                found = predict_lists(samples[sample][0], {x: sorted(m) for x, m in lists.items()}, samples[sample][1])
                done |= {(*sample, *key): preds for key, preds in found.items()}

        def outcome(row) -> DataFrame | Exception | None:
            sample = (row["dataset"], row["protected_attribute"])
            if sample not in samples:
                return KeyError(sample)
            return done[(*sample, tuple(row["techniques"]), row["model"])]

        outcomes = [outcome(row) for row in todo]
        problems = [f"{type(x).__name__}: {str(x).splitlines()[0]}" if isinstance(x, Exception) else None for x in outcomes]
        for x in outcomes:
            if isinstance(x, Exception) and not isinstance(x, RUN_ERRORS):
                raise x
        parts = [x.withColumn("run", F.lit(i)) for i, x in enumerate(outcomes) if isinstance(x, DataFrame)]
        known: dict[int, tuple] = {}
        if parts:
            folds = cut_lineage(fold_report(union_all(parts), ["run", "fold"]))  # a row a list and fold
            for weights in sorted({(r["perf_weight"], r["fair_weight"]) for r in todo}):
                for r in combined_fitness(folds, ["run"], *weights).collect():  # a row a list
                    if (todo[r["run"]]["perf_weight"], todo[r["run"]]["fair_weight"]) == weights:
                        known[r["run"]] = (r["fitness"], r["fairness_score"], r["performance_score"])
        rows = [(*row, *known.get(i, (INFEASIBLE, None, None)), problems[i]) for i, row in enumerate(todo)]
        return spark.createDataFrame(rows, EVALUATED)

    return evaluate


def blocks(keys: DataFrame, size: int) -> Iterator[DataFrame]:
    """``keys`` in tables of at most ``size`` rows; an empty one if there are none.

    Lists with a common beginning, and the models of one list, come together. The driver holds one partition at a time.
    """
    spark, schema = keys.sparkSession, keys.schema
    order = [c for c in keys.columns if c not in ("techniques", "model")]
    rows = cut_lineage(keys).orderBy(*order, "techniques", "model").toLocalIterator()
    first = True
    while (block := list(islice(rows, size))) or first:
        first = False
        yield spark.createDataFrame(block, schema)


def evaluate_queue(
    missing: DataFrame,
    evaluate: Callable[[DataFrame], DataFrame],
    folder: str,
    store_path: str | None = None,
    size: int = BLOCK,
) -> None:
    """Evaluate all keys of ``missing`` in blocks; each is in ``folder`` and in the store before the next one begins.

    So a plan is as large as a block, whatever the length of the queue, and a search that was stopped goes on where it
    was: its finished blocks are no longer missing when it starts again with the store.
    """
    for block in blocks(missing, size):
        fresh = cut_lineage(evaluate(block))
        fresh.select(*EVALUATED.names).coalesce(1).write.mode("append").parquet(folder)
        if store_path is not None:
            append_scores(fresh.drop("error"), store_path)


def run_grid(
    runs: DataFrame,
    runtime: DataFrame,
    archive: DataFrame | None = None,
    evaluate: Callable[[DataFrame], DataFrame] | None = None,
    store_path: str | None = None,
) -> DataFrame:
    """Search every run of a grid; one result row per run.

    In each generation, lists are looked up in the stores; ``evaluate`` then scores each distinct list that no store
    has once, block by block; these scores join the runtime store (and are appended at ``store_path``), and all are
    looked up again. A run with a list that failed ends as an error row without metrics. ``elapsed_seconds`` is the time until the
    generation that answers the run was scored. Without ``evaluate``, lists without a stored score are infeasible.
    """
    failed: list[DataFrame] = []
    seconds: list[float] = []
    start = time.time()
    spark, folder = runs.sparkSession, None
    store = with_weights(runtime).persist(StorageLevel.MEMORY_AND_DISK)  # every generation looks up in it
    if evaluate is not None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/evaluated-{uuid4().hex}"

    def score(population: DataFrame) -> DataFrame:
        known = store
        seconds.append(time.time() - start)  # the generation before is done
        keyed = population.withColumn("__row", F.concat_ws(":", "run_id", "slot"))
        if evaluate is not None:
            if seconds[1:]:  # blocks of the generations before
                known = known.unionByName(spark.read.schema(EVALUATED).parquet(folder).drop("error"), allowMissingColumns=True)
            evaluate_queue(missing_scores(keyed, [known] if archive is None else [known, archive]), evaluate, folder, store_path)
            fresh = spark.read.schema(EVALUATED).parquet(folder)
            bad = fresh.filter("error is not null").select(*SCORE_KEYS, "error")
            hit = with_weights(population).join(bad, SCORE_KEYS)
            failed.append(cut_lineage(hit.groupBy("run_id").agg(F.min("error").alias("error"))))
            known = store.unionByName(fresh.drop("error"), allowMissingColumns=True)
        return score_lookup(keyed, known, archive, "__row").drop("__row")

    best = cut_lineage(genetic_search(runs, score))
    store.unpersist()
    seconds.append(time.time() - start)
    took = F.element_at(F.array(*[F.lit(x) for x in seconds[1:]]), F.col("generations").cast("int"))
    if failed:
        problems = union_all(failed).groupBy("run_id").agg(F.min("error").alias("error"))
        best = best.join(problems, "run_id", "left")
    else:
        best = best.withColumn("error", F.lit(None).cast("string"))
    rows = best.withColumns(
        {
            "model_identifier": F.col("model"),
            "fairness_score": F.col("fairness"),
            "performance_score": F.col("performance"),
            "techniques": F.to_json("techniques"),
            "elapsed_seconds": took,
        }
    )
    return result_rows(rows)


def missing_scores(population: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """Distinct (dataset, model, attribute, target, practices, weights) still to be evaluated."""
    return score_misses(population, stores, SCORE_KEYS)


# ---------------------------------------------------------------------- method results


def search_method_rows(best: DataFrame, label: str = "Search") -> DataFrame:
    """Search results in the shape of the method table.

    A run without a feasible list, or with an error, has no valid metrics.
    """
    problem = F.coalesce(
        F.col("error"),
        F.when(~is_finite(F.col("fitness")), F.lit("no feasible pipeline found")),
    )
    ok = problem.isNull()

    def valid(name: str) -> Column:
        return F.when(ok, F.col(name)).alias(name)

    return best.select(
        F.col("dataset").alias("dataset_name"),
        "protected_attribute",
        "model_identifier",
        F.lit(label).alias("method"),
        valid("performance_score"),
        valid("fairness_score"),
        "elapsed_seconds",
        F.lit(None).cast("bigint").alias("undefined_fairness_folds"),
        F.when(ok, F.lit(False)).alias("fairness_undefined"),
        problem.alias("error"),
    )


def baseline_method_rows(df: DataFrame, roles: Roles, dataset: str, models: list[str], labels: list[str]) -> DataFrame:
    """Mitigation result rows of all models; a failed run has NULL metrics, zero seconds and its message."""
    spark = df.sparkSession
    keys = [F.lit(dataset).alias("dataset_name"), F.lit(roles.protected).alias("protected_attribute")]
    name_of = {MITIGATIONS[label]: label for label in labels}
    runs = baseline_runs(df, list(name_of), models, roles)
    scores = score_baselines(runs)
    for e in runs.errors.values():
        if not isinstance(e, RUN_ERRORS):
            raise e
    every = [
        (label, method, model, runs.seconds.get((method, model), 0.0) if (method, model) not in runs.errors else 0.0,
         f"{type(e).__name__}: {e}" if (e := runs.errors.get((method, model))) else None)
        for method, label in name_of.items()
        for model in models
    ]
    table = spark.createDataFrame(every, "method string, mitigation string, model string, elapsed_seconds double, error string")
    metrics = {"performance_score": "double", "fairness_score": "double", "undefined_fairness_folds": "bigint", "fairness_undefined": "boolean"}
    if scores is None:
        joined = table.select("*", *[F.lit(None).cast(t).alias(c) for c, t in metrics.items()])
    else:
        joined = table.join(scores, ["mitigation", "model"], "left")
    worked = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in metrics]
    return joined.select(
        *keys, F.col("model").alias("model_identifier"), "method", worked[0], worked[1], "elapsed_seconds", worked[2], worked[3], "error"
    )


def method_results(
    best: DataFrame, samples: dict[tuple[str, str], tuple[DataFrame, Roles]], models: list[str]
) -> DataFrame:
    """Search rows and the three mitigation rows of every (dataset, attribute, model)."""
    parts = [search_method_rows(best)]
    for (dataset, _), (df, roles) in samples.items():
        parts.append(baseline_method_rows(df, roles, dataset, models, list(MITIGATIONS)))
    return union_all(parts)
