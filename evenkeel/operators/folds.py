"""Cross-validation folds by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash32
from evenkeel.operators.ordering import hash_rank

FOLDS = 5
SEED = 42


def kfold(
    df: DataFrame, row_id: str, k: int = FOLDS, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Folds 0..k-1 whose sizes differ by at most one row."""
    ranked = hash_rank(df, [], row_id, seed, "__rank")
    return ranked.withColumn(out, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def stratified_kfold(
    df: DataFrame, label: str, row_id: str, k: int = FOLDS, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Folds that hold equal shares (within one row) of every label."""
    ranked = hash_rank(df, [label], row_id, seed, "__rank")
    return ranked.withColumn(out, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def hash_fold(
    df: DataFrame, row_id: str, k: int = FOLDS, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Folds straight from the row hash: no shuffle at all, sizes equal only on average."""
    return df.withColumn(out, F.pmod(hash32(seed, row_id), F.lit(k)).cast("int"))
