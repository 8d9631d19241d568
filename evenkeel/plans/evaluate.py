"""Cross-validated evaluation of practice lists and mitigation methods.

What several models share is made once: practices with a common beginning, preparation, folds and mitigated training parts.
Large forests and boosted models of all folds are trained together; the models of ``pyspark.ml`` are fitted side by side, before
them: the many short passes of boosting would wait behind longer tasks.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.clean import NonFiniteError, prepare_model, require_finite
from evenkeel.operators.folds import FOLDS, kfold, stratified_kfold
from evenkeel.operators.groups import coerce_labels, privileged
from evenkeel.operators.joins import keyed_join
from evenkeel.operators.lineage import cut_lineage
from evenkeel.operators.metrics import (
    average_precision,
    baseline_fairness,
    combined_fitness,
    fairness,
    fold_report,
    hard_label,
    score_minmax,
)
from evenkeel.operators.mitigation import mitigate
from evenkeel.operators.practices import CUT_AFTER, apply_practice
from evenkeel.plans import boosting, forests
from evenkeel.roles import INFEASIBLE, Roles, numeric_columns

SEED = 42
#: Models that give probabilities; the others give unbounded decision values.
PROBABILISTIC = {"lr", "rf", "xgb"}

#: Fits that run side by side, training rows that are worth a task of a fit, and the most rows of one.
SIDE_BY_SIDE, TASK_ROWS, MOST_ROWS = 8, 50_000, 4_000_000
#: The most features of forests that grow together. Wider ones, those of other labels than 0 and 1, and those of rows for
#: one task, whose draws do not hang on the number of tasks, are ``pyspark.ml``'s.
FOREST_FEATURES = 1_000

RESULT_SCHEMA = "fitness double, fairness_score double, performance_score double"


def build_classifier(model: str, n_rows: float, weight: str | None = None):
    """A fresh estimator by identifier; ``n_rows`` turns unit penalties into Spark's scale. (``xgb``: see ``BOOSTED``.)"""
    common = {"featuresCol": "features", "labelCol": "y"}
    if weight:
        common["weightCol"] = weight
    penalty = 1.0 / max(n_rows, 1.0)
    # The hyper-parameters of the study.
    if model == "lr":
        return LogisticRegression(maxIter=1000, regParam=penalty, standardization=False, **common)
    if model == "rf":
        return RandomForestClassifier(numTrees=100, maxDepth=12, seed=SEED, cacheNodeIds=True, maxMemoryInMB=1024, **common)
    if model == "svc":
        return LinearSVC(maxIter=10_000, tol=1e-4, regParam=penalty, **common)
    raise ValueError(f"unknown model identifier: {model}")


def feature_columns(df: DataFrame, *exclude: str) -> list[str]:
    """Numeric and boolean columns in table order, without ``exclude``."""
    numeric = set(numeric_columns(df))
    return [
        f.name
        for f in df.schema.fields
        if f.name not in exclude and (f.name in numeric or isinstance(f.dataType, (T.BooleanType, VectorUDT)))
    ]


def booleans_to_numbers(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("double") for c in flags}) if flags else df


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Add the ``features`` vector; any column name works, also one with dots."""
    kind = {f.name: f.dataType for f in df.schema.fields}
    plain = {f"__f{i}": F.col(f"`{c}`") if isinstance(kind[c], VectorUDT) else F.col(f"`{c}`").cast("double") for i, c in enumerate(features)}
    ready = df.withColumns(plain) if plain else df
    return VectorAssembler(inputCols=list(plain), outputCol="features").transform(ready).drop(*plain)


#: The boosted model of the study: 100 trees of depth 6 with a step of 0.3.
BOOSTED = boosting.Plan(trees=100, depth=6, rate=0.3)
#: Its forest.
FOREST = forests.Plan(trees=100, depth=12, seed=SEED)


@dataclass(frozen=True)
class Part:
    """One fit: training rows (``y``, ``features`` and possibly a weight column) and the rows to predict."""

    train: DataFrame
    test: DataFrame
    weight: str | None = None


def side_by_side(spark: SparkSession, step: Callable, tasks: list) -> list:
    """Results of independent driver steps, a few at a time, as pyspark.ml does for its own folds; errors are results."""

    def run(task):
        try:
            return step(task)
        except Exception as e:  # noqa: BLE001 - the caller raises or records it
            return e

    if not tasks:
        return []
    with ThreadPool(min(SIDE_BY_SIDE, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)


def fit_tasks(n_rows: int, beside: int, cores: int) -> int:
    """Tasks of one of ``beside`` fits at a time. Together they are about as many as the cores: every task of a forest
    holds and shuffles the statistics of all nodes of a level, so more tasks cost more than they share."""
    return max(1, min(math.ceil(n_rows / TASK_ROWS), max(math.ceil(cores / beside), math.ceil(n_rows / MOST_ROWS))))


def _fit_one(part: Part, model: str, n_rows: int, total: float, keep: list[str], beside: int) -> DataFrame:
    tasks = fit_tasks(n_rows, beside, part.train.sparkSession.sparkContext.defaultParallelism)
    # a table of few partitions, or uneven ones, is dealt out; coalescing would leave it so
    train = part.train.repartition(tasks) if tasks > 1 else part.train.coalesce(1)
    scored = build_classifier(model, total, part.weight).fit(train).transform(part.test)
    source = "probability" if model in PROBABILISTIC else "rawPrediction"
    return scored.select(*keep, vector_to_array(F.col(source))[1].alias("raw"), F.col("prediction").cast("int").alias("pred"))


def _fit_together(parts: dict[int, Part], model: str, keep: list[str]) -> dict[int, DataFrame]:
    """Predictions of the forests (``rf``) or boosted models of all parts, whose trees grow together."""
    dense = vector_to_array("features").alias("features")
    trains = [
        p.train.select(F.lit(i).alias("run"), F.col("y").cast("double").alias("y"), (F.col(p.weight) if p.weight else F.lit(1.0)).cast("double").alias("weight"), dense)
        for i, p in enumerate(parts.values())
    ]
    rows = union_all(trains).persist(StorageLevel.MEMORY_AND_DISK)
    width = rows.select(F.size("features").alias("n")).first()["n"]
    if model == "rf":
        forest = forests.fit(rows, width, FOREST)
    else:
        forest = boosting.fit(rows, len(parts), width, BOOSTED)
    rows.unpersist()
    tests = union_all([p.test.select(F.lit(i).alias("run"), *keep, dense) for i, p in enumerate(parts.values())])
    scored = cut_lineage(forest.predict(tests).withColumn("pred", (F.col("raw") > 0.5).cast("int")))
    return {key: scored.filter(F.col("run") == i).drop("run") for i, key in enumerate(parts)}


def predict_all(parts: list[Part], models: Iterable[str]) -> dict[tuple[int, str], DataFrame | Exception | None]:
    """Predictions of fresh models on each part's test rows: its columns but vectors, with ``raw`` (score) and ``pred``.

    None where the training labels do not hold two classes; an error where a fit failed. Test rows of all parts have the
    same column names; types and the number of features may differ, then models grow in several batches.
    """
    if not parts:
        return {}
    spark, names = parts[0].train.sparkSession, list(models)
    keep = [f.name for f in parts[0].test.schema.fields if not isinstance(f.dataType, VectorUDT)]

    def size(part: Part):
        weight = F.col(part.weight) if part.weight else F.lit(1.0)
        width = F.max(F.size(vector_to_array("features")))
        binary = F.every(F.coalesce(F.col("y").isin(0, 1), F.lit(False)))
        return part.train.agg(
            F.count("*").alias("rows"), F.sum(weight).alias("n"), F.count_distinct("y").alias("classes"), width.alias("width"), binary.alias("binary")
        ).first()

    sizes = side_by_side(spark, size, parts)
    done: dict[tuple[int, str], DataFrame | Exception | None] = {}
    fit: list[int] = []
    for i, found in enumerate(sizes):
        if isinstance(found, Exception) or found["classes"] < 2:
            done |= {(i, m): found if isinstance(found, Exception) else None for m in names}
        else:
            fit.append(i)
    large = [i for i in fit if sizes[i]["rows"] > TASK_ROWS and sizes[i]["binary"] and 0 < sizes[i]["width"] <= FOREST_FEATURES]
    grown = {"rf": large, "xgb": fit}
    # the longest fits first
    order = sorted((m for m in names if m != "xgb"), key=lambda m: ("rf", "svc", "lr").index(m) if m in ("rf", "svc", "lr") else 3)
    tasks = [(i, m) for m in order for i in fit if i not in grown.get(m, ())]

    def step(task: tuple[int, str]) -> DataFrame:
        i, model = task
        return cut_lineage(_fit_one(parts[i], model, sizes[i]["rows"], sizes[i]["n"], keep, min(SIDE_BY_SIDE, len(tasks))))

    done |= dict(zip(tasks, side_by_side(spark, step, tasks)))
    for model in [m for m in grown if m in names]:
        alike: dict[tuple[int, str], list[int]] = {}
        for i in grown[model]:
            alike.setdefault((sizes[i]["width"], parts[i].test.select(*keep).schema.simpleString()), []).append(i)

        def grow(members: list[int], model: str = model) -> dict[int, DataFrame]:
            return _fit_together({i: parts[i] for i in members}, model, keep)

        for same in alike.values():
            # forests are large: a few at a time
            few = SIDE_BY_SIDE if model == "rf" else len(same)
            for members in (same[a : a + few] for a in range(0, len(same), few)):
                found = side_by_side(spark, grow, [members])[0]
                done |= {(i, model): found if isinstance(found, Exception) else found[i] for i in members}
    return done


def fit_predict(train: DataFrame, test: DataFrame, model: str, weight: str | None = None) -> DataFrame | None:
    """Predictions of one fresh model; see :func:`predict_all`."""
    if model not in (*PROBABILISTIC, "svc"):
        raise ValueError(f"unknown model identifier: {model}")
    found = predict_all([Part(train, test, weight)], [model])[0, model]
    if isinstance(found, Exception):
        raise found
    return found


def fold_parts(folded: DataFrame, k: int = FOLDS) -> list[Part]:
    """Each fold as test rows of the others; ``folded`` has ``fold``, ``y`` and ``features``."""
    return [Part(folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)) for i in range(k)]


def cross_predict_many(
    tables: list[DataFrame], models: Iterable[str], k: int = FOLDS
) -> list[dict[str, DataFrame | Exception | None]]:
    """Out-of-fold predictions of each model for every table (``fold``, ``y``, ``features``), all fitted in one call."""
    names = list(models)
    kept = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables]
    found = predict_all([part for t in kept for part in fold_parts(t, k)], names)
    for t in kept:
        t.unpersist()
    out = []
    for first in range(0, k * len(kept), k):
        by_model: dict[str, DataFrame | Exception | None] = {}
        for m in names:
            parts = [found[i, m] for i in range(first, first + k)]
            errors = [p for p in parts if isinstance(p, Exception)]
            good = [p for p in parts if p is not None]
            by_model[m] = errors[0] if errors else union_all(good) if good else None
        out.append(by_model)
    return out


def cross_predict_all(folded: DataFrame, models: Iterable[str], k: int = FOLDS) -> dict[str, DataFrame | Exception | None]:
    """Out-of-fold predictions of each model for one table."""
    return cross_predict_many([folded], models, k)[0]


def cross_predict(folded: DataFrame, model: str, k: int = FOLDS) -> DataFrame | None:
    """Out-of-fold predictions of one model."""
    found = cross_predict_all(folded, [model], k)[model]
    if isinstance(found, Exception):
        raise found
    return found


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_problem(df: DataFrame, target: str) -> bool:
    """True if the label is empty, of one class, or incomplete for a pair to be mapped."""
    seen = df.agg(
        F.count_distinct(target).alias("n"),
        F.count_if(F.col(target).isNull()).alias("missing"),
    ).first()
    return seen["n"] < 2 or (seen["n"] == 2 and seen["missing"] > 0)


def infeasible(spark) -> DataFrame:
    return spark.createDataFrame([(INFEASIBLE, None, None)], RESULT_SCHEMA)


def practice_tree(df: DataFrame, lists: Iterable[Iterable[str]], roles: Roles) -> dict[tuple[str, ...], DataFrame | Exception]:
    """The table after each practice list; what several lists begin with is applied once and materialised.

    A failing practice fails all lists that begin with it.
    """
    wanted = sorted({tuple(x) for x in lists})
    uses = Counter(steps[:i] for steps in wanted for i in range(1, len(steps) + 1))
    made: dict[tuple[str, ...], DataFrame | Exception] = {(): df}
    for steps in wanted:
        for i in range(1, len(steps) + 1):
            key, before = steps[:i], made[steps[: i - 1]]
            if key in made:
                continue
            if isinstance(before, Exception):
                made[key] = before
                continue
            try:
                out = apply_practice(before, key[-1], roles)
                shared = uses[key] > 1 or (key[-1] in CUT_AFTER and i < len(steps))
                made[key] = cut_lineage(out) if shared else out
            except Exception as e:  # noqa: BLE001 - the caller raises or records it
                made[key] = e
    return {steps: made[steps] for steps in wanted}


def _folded(shaped: DataFrame, roles: Roles, mode: str) -> DataFrame | None:
    """The prepared table with folds, ``y`` and ``features``; None when its label cannot be learnt."""
    ready = cut_lineage(prepare_model(shaped, roles.target, roles.row_id, roles.protected, mode=mode))
    features = feature_columns(ready, roles.row_id, roles.target)
    require_finite(ready, numeric_columns(ready, roles.row_id, roles.target), "features")
    if label_problem(ready, roles.target):
        return None
    folded = assemble(kfold(ready.withColumn("y", F.col(roles.target).cast("int")), roles.row_id), features)
    return folded.select(roles.row_id, roles.protected, "fold", "y", "features")


def search_predictions_all(
    df: DataFrame, lists: Iterable[Iterable[str]], models: Iterable[str], roles: Roles, mode: str = "sorted"
) -> dict[tuple[tuple[str, ...], str], DataFrame | Exception | None]:
    """Out-of-fold predictions after each practice list by each model; see :func:`predict_lists`."""
    names = list(models)
    return predict_lists(df, {tuple(x): names for x in lists}, roles, mode)


def predict_lists(
    df: DataFrame, wanted: dict[tuple[str, ...], list[str]], roles: Roles, mode: str = "sorted"
) -> dict[tuple[tuple[str, ...], str], DataFrame | Exception | None]:
    """Out-of-fold predictions after each practice list by its models; None when nothing can be learnt.

    The practices run before the folds are drawn, and the protected column stays a feature. A list is prepared and
    folded once for all its models; the folds of all lists that want the same models are fitted in one call, so their
    boosted models grow together. The tables of all lists are held (in memory or on disk) at once: pass long queues in blocks.
    """
    out: dict[tuple[tuple[str, ...], str], DataFrame | Exception | None] = {}
    shaped = practice_tree(df, wanted, roles)

    def prepare(steps: tuple[str, ...]) -> DataFrame | None:
        table = shaped[steps]
        if isinstance(table, Exception):
            raise table
        return _folded(table, roles, mode)

    together: dict[tuple[str, ...], list[tuple[tuple[str, ...], DataFrame]]] = {}
    for steps, folded in zip(shaped, side_by_side(df.sparkSession, prepare, list(shaped))):
        if folded is None or isinstance(folded, Exception):
            out |= {(steps, m): folded for m in wanted[steps]}
        else:
            together.setdefault(tuple(sorted(wanted[steps])), []).append((steps, folded))
    for names, tables in together.items():
        for (steps, _), found in zip(tables, cross_predict_many([t for _, t in tables], names)):
            for m, preds in found.items():
                if preds is not None and not isinstance(preds, Exception):
                    grouped = privileged(preds, roles.protected, ["fold"], roles.row_id)
                    preds = grouped.select(F.col(roles.row_id).cast("string").alias("row_id"), "fold", "y", "s", F.col("raw").alias("score"), "pred")
                out[steps, m] = preds
    return out


def search_predictions(df: DataFrame, techniques: list[str], model: str, roles: Roles, mode: str = "sorted") -> DataFrame | None:
    """Out-of-fold predictions after one practice list; see :func:`search_predictions_all`."""
    found = search_predictions_all(df, [techniques], [model], roles, mode)[tuple(techniques), model]
    if isinstance(found, Exception):
        raise found
    return found


def evaluate_lists(
    df: DataFrame,
    lists: Iterable[Iterable[str]],
    models: Iterable[str],
    roles: Roles,
    perf_weight: float = 0.5,
    fair_weight: float = 0.5,
    mode: str = "sorted",
) -> DataFrame:
    """``techniques`` (joined by commas), ``model``, ``fitness, fairness_score, performance_score`` of every list and model.

    All predictions are scored together. The first failure is raised.
    """
    found = search_predictions_all(df, lists, models, roles, mode)
    for preds in found.values():
        if isinstance(preds, Exception):
            raise preds
    label = lambda key: [F.lit(",".join(key[0])).alias("techniques"), F.lit(key[1]).alias("model")]
    keys = ["techniques", "model"]
    parts = [preds.select(*label(k), "*") for k, preds in found.items() if preds is not None]
    rows = [infeasible(df.sparkSession).select(*label(k), "*") for k, preds in found.items() if preds is None]
    if parts:
        every = cut_lineage(union_all(parts))
        fitness = combined_fitness(fold_report(every, [*keys, "fold"]), keys, perf_weight, fair_weight)
        rows.append(fitness.select(*keys, "fitness", "fairness_score", "performance_score"))
    return union_all(rows)


def evaluate_practices(
    df: DataFrame,
    techniques: list[str],
    model: str,
    roles: Roles,
    perf_weight: float = 0.5,
    fair_weight: float = 0.5,
    mode: str = "sorted",
) -> DataFrame:
    """(fitness, fairness_score, performance_score) of one practice list; one row."""
    preds = search_predictions(df, techniques, model, roles, mode)
    if preds is None:
        return infeasible(df.sparkSession)
    one = fold_report(preds, ["fold"]).withColumn("run", F.lit(0))
    return combined_fitness(one, ["run"], perf_weight, fair_weight).select(
        "fitness", "fairness_score", "performance_score"
    )


@dataclass
class BaselineRuns:
    """Predictions of all (method, model) runs that worked (None if none did), their seconds and the errors of the others."""

    predictions: DataFrame | None
    seconds: dict[tuple[str, str], float]
    errors: dict[tuple[str, str], Exception]


def baseline_runs(df: DataFrame, methods: Iterable[str], models: Iterable[str], roles: Roles) -> BaselineRuns:
    """Out-of-fold predictions with each mitigation applied to each training part only.

    Folds are balanced by label and the protected column is not a feature. Every (method, fold) is mitigated once and
    serves all models; all boosted models grow together. ``seconds`` are those of all runs, which share their work.
    """
    start, spark = time.time(), df.sparkSession
    methods, models = list(methods), list(models)
    folded = cut_lineage(stratified_kfold(booleans_to_numbers(df), roles.target, roles.row_id))
    features = feature_columns(folded, roles.row_id, roles.target, roles.protected, "fold")
    tests = assemble(folded.withColumn("y", F.col(roles.target).cast("int")), features)
    tests = tests.select(*dict.fromkeys([roles.row_id, roles.target, roles.protected, "fold", "y", "features"])).persist(StorageLevel.MEMORY_AND_DISK)

    def mitigated(task: tuple[str, int]) -> Part:
        method, fold = task
        changed, weight = mitigate(folded.filter(F.col("fold") != fold).drop("fold"), method, roles)
        ready = assemble(changed.withColumn("y", F.col(roles.target).cast("int")), features)
        kept = ready.select("y", "features", *([weight] if weight else []))
        return Part(cut_lineage(kept), tests.filter(F.col("fold") == fold), weight)

    tasks = [(m, f) for m in methods for f in range(FOLDS)]
    made = side_by_side(spark, mitigated, tasks)
    errors: dict[tuple[str, str], Exception] = {}
    for (method, _), part in zip(tasks, made):
        if isinstance(part, Exception):
            errors |= {(method, m): errors.get((method, m), part) for m in models}
    good = [(t, p) for t, p in zip(tasks, made) if not isinstance(p, Exception) and (t[0], models[0]) not in errors]
    found = predict_all([p for _, p in good], models)
    rows = []
    for method in methods:
        for model in models:
            parts = [found[i, model] for i, ((m, _), _) in enumerate(good) if m == method]
            bad = [p for p in parts if p is None or isinstance(p, Exception)]
            if bad:
                errors.setdefault((method, model), bad[0] or ValueError("a training part holds a single class"))
            elif parts:
                rows.append(union_all(parts).select(F.lit(method).alias("mitigation"), F.lit(model).alias("model"), "*"))
    if not rows:
        return BaselineRuns(None, {}, errors)
    every, keys = cut_lineage(union_all(rows)), ["mitigation", "model", "fold"]
    tests.unpersist()
    sure = every.filter(F.col("model").isin(*PROBABILISTIC)).withColumn("score", F.col("raw"))
    scaled = score_minmax(every.filter(~F.col("model").isin(*PROBABILISTIC)), "raw", keys, roles.row_id)
    grouped = privileged(hard_label(sure.unionByName(scaled)), roles.protected, keys, roles.row_id)
    labelled = coerce_labels(grouped, roles.target, keys, roles.row_id)
    preds = cut_lineage(labelled.select("mitigation", "model", F.col(roles.row_id).alias("row_id"), "fold", "y", "s", "score", "pred"))
    elapsed = time.time() - start
    done = {(m, x): elapsed / (len(methods) * len(models)) for m in methods for x in models if (m, x) not in errors}
    return BaselineRuns(preds, done, errors)


def score_baselines(runs: BaselineRuns) -> DataFrame | None:
    """One row a (mitigation, model): mean average precision, fairness score, its undefined folds, undefinedness.

    Runs with scores that are no numbers are moved to ``runs.errors``.
    """
    if runs.predictions is None:
        return None
    preds, keys = runs.predictions, ["mitigation", "model"]
    for r in preds.filter(F.col("score").isNull() | F.isnan("score")).select(*keys).distinct().collect():  # one row a run
        runs.errors[r["mitigation"], r["model"]] = NonFiniteError(f"{r['mitigation']} classifier scores")
    perf = average_precision(preds, [*keys, "fold"]).groupBy(*keys).agg(F.avg("average_precision").alias("performance_score"))
    fair = baseline_fairness(fairness(preds, [*keys, "fold"]), keys)
    return keyed_join(perf, fair, keys).select(*keys, "performance_score", "fairness_score", "undefined_fairness_folds", "fairness_undefined")


def evaluate_baseline(df: DataFrame, method: str, model: str, roles: Roles) -> DataFrame:
    """One row: mean average precision, fairness score, its undefined folds, seconds. Failures are raised."""
    runs = baseline_runs(df, [method], [model], roles)
    scores = score_baselines(runs)
    if runs.errors:
        raise runs.errors[method, model]
    return scores.select(
        "performance_score",
        "fairness_score",
        F.lit(runs.seconds[method, model]).alias("elapsed_seconds"),
        "undefined_fairness_folds",
        "fairness_undefined",
    )
