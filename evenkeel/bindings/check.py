"""Shared shaping of query results so that both engines return comparable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions.ratios import INF


def r6(name: str, digits: int = 6, out: str | None = None) -> Column:
    """Rounded double; both zeros are written as 0."""
    return (F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(out or name)


def state(name: str) -> list[Column]:
    """A possibly unbounded value as (finite value or NULL, 'defined'/'undefined'/'unbounded')."""
    col = F.col(name)
    return [
        F.round(F.when(F.abs(col) != INF, col), 6).alias(name),
        F.when(col.isNull(), "undefined")
        .when(F.abs(col) == INF, "unbounded")
        .otherwise("defined")
        .alias(f"{name}_state"),
    ]


def state_sql(expr: str, name: str) -> str:
    return (
        f"round(case when not isinf({expr}) then {expr} end, 6) as {name}, "
        f"case when {expr} is null then 'undefined' when isinf({expr}) then 'unbounded' "
        f"else 'defined' end as {name}_state"
    )
