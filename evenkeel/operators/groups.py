"""Privileged-group rules and label coercion, evaluated per group of rows (fold, run...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.recode import equals_one, privileged_sex, to_number
from evenkeel.operators.joins import attach


def by_mean(df: DataFrame, column: str, keys: list[str], row_id: str, out: str = "s") -> DataFrame:
    """1 above the mean of the row's own ``keys`` group (its test fold); NULL counts as 0."""
    value = to_number(F.col(column))
    means = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.count("*").alias("__n"))
    joined = attach(df, means, keys, "__n", F.col(row_id))
    hit = F.coalesce(value > F.col("__mean"), F.lit(False))
    return joined.withColumn(out, hit.cast("int")).drop("__mean", "__n")


def by_mode(
    df: DataFrame, column: str, keys: list[str], row_id: str, out: str = "s"
) -> DataFrame:
    """1 for the most frequent value of the row's group.

    NULLs compete; when NULL wins, nobody is privileged. Ties go to the value seen first.
    """
    counts = df.groupBy(*keys, column).agg(
        F.count("*").alias("__n"), F.min(row_id).alias("__first")
    )
    # the most frequent value; ties go to the smallest first-seen identifier
    rank = F.struct((-F.col("__n")).alias("o"), "__first")
    winner = counts.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(column).alias("v")), rank).alias("__top"),
        F.sum("__n").alias("__size"),
    )
    joined = attach(df, winner, keys, "__size", F.col(row_id))
    hit = F.coalesce(F.col(column) == F.col("__top")["v"], F.lit(False))
    return joined.withColumn(out, hit.cast("int")).drop("__top", "__size")


def privileged(
    df: DataFrame,
    column: str,
    keys: list[str],
    row_id: str,
    rule: str | None = None,
    out: str = "s",
) -> DataFrame:
    """Binary privileged indicator by an explicit ``rule``, else by the column's name.

    Names are searched for 'sex', then 'race', then 'age'; other columns use the mode.
    """
    name = column.lower()
    rule = rule or next((r for r in ("sex", "race", "age") if r in name), "mode")
    if rule == "sex":
        return df.withColumn(out, privileged_sex(df, column))
    if rule == "race":
        return df.withColumn(out, equals_one(F.col(column)))
    if rule == "age":
        return by_mean(df, column, keys, row_id, out)
    if rule == "mode":
        return by_mode(df, column, keys, row_id, out)
    raise ValueError(f"unknown rule {rule!r}")


def coerce_labels(
    df: DataFrame, column: str, keys: list[str], row_id: str, out: str = "y"
) -> DataFrame:
    """Binary labels per group: {0,1} stays, {1,2} maps 2 to 1; anything else is NULL."""
    value = F.col(column)
    seen = df.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.coalesce(F.bool_and(value.isin(0, 1)), F.lit(True)).alias("__zero_one"),
        F.coalesce(F.bool_and(value.isin(1, 2)), F.lit(True)).alias("__one_two"),
    )
    joined = attach(df, seen, keys, "__n", F.col(row_id))
    label = F.when(F.col("__zero_one"), value.cast("int")).when(
        F.col("__one_two"), value.cast("int") - 1
    )
    return joined.withColumn(out, label).drop("__n", "__zero_one", "__one_two")
