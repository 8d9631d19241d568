"""Column roles of a labelled table and the fixed names used across the package."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of the eight practices, in catalogue order.
TECHNIQUES = [
    "standard",
    "stratified_sampling",
    "oversampling",
    "undersampling",
    "clustering",
    "ipw",
    "matching",
    "min_max_scaling",
]

# Classifier identifiers.
MODELS = ["rf", "lr", "svc", "xgb"]

# Fitness of an infeasible run and the score of undefined baseline fairness.
INFEASIBLE = float("-inf")
FAIRNESS_WHEN_UNDEFINED = 1.0


@dataclass(frozen=True)
class Roles:
    """Which columns identify a row, carry the label and mark the protected group.

    Spark tables have no row order, so ``row_id`` must be unique and stable: samplers,
    folds and tie-breaks are all derived from it.
    """

    row_id: str
    target: str
    protected: str

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)


def numeric_columns(df: DataFrame, *exclude: str) -> list[str]:
    """Numeric (never boolean) columns in table order, without ``exclude``."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Return ``df``; raise if any needed column is absent, naming all of them."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
