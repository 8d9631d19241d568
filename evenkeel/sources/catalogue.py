"""Dataset catalogue and the grid of search runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.recode import PREPARERS
from evenkeel.operators.clean import prepare_model
from evenkeel.operators.lineage import cut_lineage
from evenkeel.roles import MODELS
from evenkeel.sources.tables import load_dataset

# Fixed values: (name, path, preparer, protected attributes, target) of the study datasets.
DATASETS = [
    ("adult", "datasets/adult.csv", "income", ["race", "sex"], "salary"),
    ("german", "datasets/german.csv", "credit", ["sex", "age"], "Target"),
    ("heart", "datasets/heart.csv", "diagnosis", ["sex", "age"], "num"),
]
CATALOGUE_SCHEMA = (
    "name string, path string, preparer string, protected_attributes array<string>, target string"
)

# The parameter grid of the study.
POPULATION_SIZES = [5, 10, 15, 20, 50, 100]
GENERATION_COUNTS = [5, 10, 15, 20, 50, 100]
RATES = [0.0, 0.25, 0.5, 0.75, 1.0]


def catalogue(spark: SparkSession, datasets: list[tuple] = DATASETS) -> DataFrame:
    return spark.createDataFrame(datasets, CATALOGUE_SCHEMA)


def join_catalogue(df: DataFrame, datasets: DataFrame, path: str = "dataset") -> DataFrame:
    """Add the catalogue entry of each row's dataset path; unknown paths drop out."""
    return df.join(datasets, F.col(path) == datasets["path"]).drop("path")


def build_tasks(
    datasets: DataFrame,
    protected: list[str] | None = None,
    population_sizes: list[int] = POPULATION_SIZES,
    generation_counts: list[int] = GENERATION_COUNTS,
    alphas: list[float] = RATES,
    betas: list[float] = RATES,
    models: list[str] = MODELS,
) -> DataFrame:
    """All grid points: dataset x kept attribute x the given parameter values x model."""
    grid = datasets.select(
        F.col("name").alias("dataset"),
        "target",
        F.explode("protected_attributes").alias("protected_attribute"),
    )
    if protected is not None:
        grid = grid.filter(F.col("protected_attribute").isin(*protected))
    for name, values in (
        ("population_size", population_sizes),
        ("generations", generation_counts),
        ("alpha", alphas),
        ("beta", betas),
        ("model", models),
    ):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def prepare_sample(
    raw: DataFrame, preparer: str, target: str, protected: str, row_id: str
) -> DataFrame:
    """Recode and prepare a dataset without binarising its label."""
    recoded = PREPARERS[preparer](raw)
    if protected not in recoded.columns:
        raise ValueError(f"protected column {protected!r} not found after preparation")
    return prepare_model(recoded, target, row_id, protected, binarize=False)


def load_task_sample(
    spark: SparkSession, root: str, name: str, protected: str, row_id: str = "row_id", schema=None
) -> DataFrame:
    """Read a catalogue dataset below ``root`` and prepare it for one protected attribute.

    A file without ``row_id`` gets one, fixed by a checkpoint so that it cannot change.
    """
    entry = {d[0]: d for d in DATASETS}[name]
    raw = load_dataset(spark, f"{root}/{entry[1]}", schema)
    if row_id not in raw.columns:
        raw = cut_lineage(raw.withColumn(row_id, F.monotonically_increasing_id()))
    return prepare_sample(raw, entry[2], entry[4], protected, row_id)
