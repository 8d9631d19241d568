"""Joining per-group tables onto rows without trusting their size or the key balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.lineage import cut_lineage

#: A group table is broadcast only after it has been seen to hold no more rows than this.
BROADCAST_ROWS = 10_000
#: A group with at least this share of the rows is hot; at most ``HOT_PARTS`` of them can exist.
HOT_PARTS = 1_000


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    cond = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__k_{k}" for k in keys])


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    weight: str,
    spread: Column,
    how: str = "inner",
    stored: bool = False,
) -> DataFrame:
    """Add the columns of ``groups`` (one row per key) to every row of its group.

    Up to ``BROADCAST_ROWS`` groups are broadcast: their number is checked, not guessed.
    Beyond that, groups holding at least 1/``HOT_PARTS`` of the rows (so at most
    ``HOT_PARTS`` groups) are broadcast, and their rows are scattered by ``spread`` in the
    shuffled join that serves all other groups; no task receives a hot group whole.
    ``weight`` is the column of ``groups`` that counts the group's rows. A large group
    table is written to the checkpoint folder, since it is read several times, unless it
    is ``stored`` already.
    """
    if not keys:  # one group holds all rows
        one = {"__one": F.lit(0)}
        joined = attach(
            rows.withColumns(one), groups.withColumns(one), ["__one"], weight, spread, how, stored
        )
        return joined.drop("__one")
    spark = rows.sparkSession
    known = groups.limit(BROADCAST_ROWS + 1).collect()
    if len(known) <= BROADCAST_ROWS:
        small = spark.createDataFrame(known, groups.schema)
        return keyed_join(rows, F.broadcast(small), keys, how)

    groups = groups if stored else cut_lineage(groups)
    total = groups.agg(F.sum(weight).alias("t")).first()["t"]
    is_hot = F.col(weight) * HOT_PARTS >= F.lit(total)
    hot = spark.createDataFrame(groups.filter(is_hot).collect(), groups.schema)
    extra = [c for c in groups.columns if c not in keys]
    hot_side = hot.select(
        *keys, F.struct(*extra).alias("__hot"), F.lit(True).alias("__is_hot")
    )
    salted = keyed_join(rows, F.broadcast(hot_side), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__is_hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(
            F.lit(0).cast("bigint")
        ),
    )
    cold = groups.filter(~is_hot).select(
        *keys, F.struct(*extra).alias("__cold"), F.lit(0).cast("bigint").alias("__salt")
    )
    joined = keyed_join(salted, cold, [*keys, "__salt"], "left")
    merged = F.coalesce("__hot", "__cold")
    if how == "inner":
        joined = joined.filter(merged.isNotNull())
    return joined.select(*rows.columns, *[merged[c].alias(c) for c in extra])


def explode_range(df: DataFrame, count: Column, out: str, chunk: int = 10_000) -> DataFrame:
    """One row per integer 0..count-1, generated in chunks spread over all tasks.

    Chunks are listed in two levels, so no task makes a list longer than ``chunk`` for up to ``chunk`` ** 3 rows.
    """
    keys = [F.col(c) for c in df.columns]
    last = F.floor((F.col("__n") - 1) / chunk)
    blocks = df.withColumn("__n", count.cast("bigint")).filter("__n > 0").withColumn(
        "__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / chunk)))
    )
    first = F.col("__b") * chunk
    chunks = blocks.repartition(*keys, F.col("__b")).withColumn(
        "__c", F.explode(F.sequence(first, F.least(first + chunk - 1, last)))
    )
    start = F.col("__c") * chunk
    stop = F.least(start + chunk, F.col("__n")) - 1
    return (
        chunks.repartition(*keys, F.col("__c"))
        .withColumn(out, F.explode(F.sequence(start, stop)))
        .drop("__n", "__b", "__c")
    )
