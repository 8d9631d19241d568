"""Exact ranks, prefix sums, quantiles and samples without a single-task sort.

Two-level scheme throughout: rows are cut into many small cells (by hash prefix, or by
value range), the cells are counted, the counts of each group are accumulated (at most
one row per cell), and only the inside of a cell is ever sorted.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash32
from evenkeel.functions.ratios import INF
from evenkeel.operators.joins import attach, keyed_join

#: Low bits of the 32-bit hash kept inside a cell: 2**14 hash cells per group.
CELL_BITS = 18
#: Rows aimed at per value cell, and the most value cells per table.
CELL_ROWS = 100_000
MAX_CELLS = 4_096


def _before(keys: list[str], order: str, measure: str) -> Column:
    w = (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(measure).over(w), F.lit(0))


# --------------------------------------------------------------------------- hash order


def _with_hash_cell(df: DataFrame, row_id: str, seed: int | str) -> DataFrame:
    return df.withColumn("__h", hash32(seed, row_id)).withColumn(
        "__cell", F.shiftright("__h", CELL_BITS)
    )


def hash_rank(
    df: DataFrame, keys: list[str], row_id: str, seed: int | str, out: str = "rank"
) -> DataFrame:
    """Dense 1-based rank of every row in the hash order of its group."""
    rows = _with_hash_cell(df, row_id, seed)
    cells = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    offsets = cells.select(*keys, "__cell", _before(keys, "__cell", "__n").alias("__off"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__h", row_id)
    local = rows.withColumn("__r", F.row_number().over(inside))
    return (
        keyed_join(local, offsets, [*keys, "__cell"])
        .withColumn(out, F.col("__r") + F.col("__off"))
        .select(*df.columns, out)
    )


def take_per_group(
    df: DataFrame, keys: list[str], row_id: str, n: int, seed: int | str
) -> DataFrame:
    """Exactly ``n`` rows of every group (all rows of smaller ones): the n smallest hashes.

    Whole cells below the group's boundary cell pass without any shuffle; only rows of the
    boundary cell are ranked.
    """
    if n <= 0:
        return df.limit(0)
    group = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    rows = _with_hash_cell(base, row_id, seed)
    cells = rows.groupBy(*group, "__cell").agg(F.count("*").alias("__n"))
    every = Window.partitionBy(*group)
    cuts = (
        cells.withColumn("__off", _before(group, "__cell", "__n"))
        .withColumn("__size", F.sum("__n").over(every))
        .withColumn("__last", F.max("__cell").over(every))
        .filter(
            ((F.col("__off") < n) & (F.col("__off") + F.col("__n") >= n))
            | ((F.col("__size") < n) & (F.col("__cell") == F.col("__last")))
        )
        .select(*group, F.col("__cell").alias("__cut"), (n - F.col("__off")).alias("__need"), "__size")
    )
    marked = attach(rows, cuts, group, "__size", F.col(row_id))
    whole = marked.filter(F.col("__cell") < F.col("__cut")).select(*df.columns)
    inside = Window.partitionBy(*group).orderBy("__h", row_id)
    edge = (
        marked.filter(F.col("__cell") == F.col("__cut"))
        .withColumn("__r", F.row_number().over(inside))
        .filter(F.col("__r") <= F.col("__need"))
        .select(*df.columns)
    )
    return whole.unionByName(edge)


# -------------------------------------------------------------------------- value order


def value_cells(rows: DataFrame, value: str) -> list[float]:
    """Bounds that cut the values of ``rows`` into cells of about ``CELL_ROWS`` rows.

    They are approximate quantiles and only balance the work; any bounds give the same
    results. Heavily repeated values yield one bound.
    """
    probs = ",".join(str(i / MAX_CELLS) for i in range(1, MAX_CELLS))
    found = rows.agg(
        F.count(value).alias("n"),
        F.percentile_approx(
            F.col(value).cast("double"), F.split(F.lit(probs), ",").cast("array<double>"), 2 * MAX_CELLS
        ).alias("b"),
    ).first()
    wanted = min(MAX_CELLS, -(-found["n"] // CELL_ROWS))
    if wanted <= 1:
        return []
    step = max(1, MAX_CELLS // wanted)
    return sorted({b + 0.0 for b in found["b"][step - 1 :: step] if math.isfinite(b)})


def with_cell(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Add ``__cell``, the order-preserving cell number of ``value``."""
    if not bounds:
        return df.withColumn("__cell", F.lit(0.0))
    splits = [-INF, *bounds, INF]
    numbered = Bucketizer(
        splits=splits, inputCol="__num", outputCol="__cell", handleInvalid="keep"
    ).transform(df.withColumn("__num", F.col(value).cast("double")))
    return numbered.drop("__num")


def prefix_sums(
    counts: DataFrame, keys: list[str], value: str, measures: list[str], bounds: list[float]
) -> DataFrame:
    """Add ``before_<m>`` and ``total_<m>``: sums over smaller values, and over the group.

    ``counts`` has one row per (keys, value); ``bounds`` come from :func:`value_cells`. Without bounds all values fit
    into one cell, so one shuffle by ``keys`` gives both sums.
    """
    every = Window.partitionBy(*keys)
    if not bounds:
        before = {f"before_{m}": _before(keys, value, m) for m in measures}
        totals = {f"total_{m}": F.sum(m).over(every) for m in measures}
        return counts.select(*counts.columns, *[c.alias(name) for name, c in {**before, **totals}.items()])
    rows = with_cell(counts, value, bounds)
    sums = rows.groupBy(*keys, "__cell").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = sums.select(
        *keys,
        "__cell",
        *[_before(keys, "__cell", m).alias(f"__off_{m}") for m in measures],
        *[F.sum(m).over(every).alias(f"total_{m}") for m in measures],
    )
    local = rows
    for m in measures:
        local = local.withColumn(f"__loc_{m}", _before([*keys, "__cell"], value, m))
    joined = keyed_join(local, offsets, [*keys, "__cell"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"__loc_{m}") + F.col(f"__off_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def running_max(
    rows: DataFrame, keys: list[str], value: str, measure: str, bounds: list[float], out: str
) -> DataFrame:
    """Add the largest ``measure`` over values up to and including the row's own.

    ``rows`` has one row per (keys, value).
    """
    marked = with_cell(rows, value, bounds)
    upto = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    tops = (
        marked.groupBy(*keys, "__cell")
        .agg(F.max(measure).alias("__top"))
        .select(*keys, "__cell", F.max("__top").over(earlier).alias("__prev"))
    )
    local = marked.withColumn("__here", F.max(measure).over(upto))
    return keyed_join(local, tops, [*keys, "__cell"]).select(
        *rows.columns, F.greatest("__here", "__prev").alias(out)
    )


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one column per entry of ``probs``.

    ``weight`` names a column that says how often a row counts. NULL values are ignored. Rows are counted per cell
    first; only those of the cells that contain a wanted position are moved and sorted, so neither a huge group nor many
    distinct values ever sit in one task. Groups without any value are absent from the result.
    """
    data = rows.filter(F.col(value).isNotNull())
    repeats = F.sum(weight) if weight else F.count("*")
    cell_rows = with_cell(data.select(*keys, value, *([weight] if weight else [])), value, value_cells(data, value))
    every = Window.partitionBy(*keys)
    offsets = (
        cell_rows.groupBy(*keys, "__cell")
        .agg(repeats.alias("__cn"))
        .withColumn("__off", _before(keys, "__cell", "__cn"))
        .withColumn("__size", F.sum("__cn").over(every))
    )
    ends = []
    for q in probs.values():
        at = (F.col("__size") - 1) * F.lit(float(q))
        ends += [F.floor(at), F.ceil(at)]

    def holds(lo: Column, size: Column) -> Column:
        hit = F.lit(False)
        for e in ends:
            hit = hit | ((lo <= e) & (e < lo + size))
        return hit

    wanted = offsets.filter(holds(F.col("__off"), F.col("__cn"))).select(
        *keys, "__cell", "__off", "__size", "__cn"
    )
    held = attach(cell_rows, wanted, [*keys, "__cell"], "__cn", F.col(value))
    counts = held.groupBy(*keys, "__cell", "__off", "__size", value).agg(repeats.alias("__n"))
    ranked = counts.withColumn(
        "__at", F.col("__off") + _before([*keys, "__cell"], value, "__n")
    )
    picks = []
    for i in range(len(probs)):
        for side, e in (("lo", ends[2 * i]), ("hi", ends[2 * i + 1])):
            here = (F.col("__at") <= e) & (e < F.col("__at") + F.col("__n"))
            picks.append(
                F.max(F.when(here, F.col(value).cast("double"))).alias(f"__{side}{i}")
            )
    found = ranked.groupBy(*keys).agg(F.max("__size").alias("__size"), *picks)
    out = []
    for i, (name, q) in enumerate(probs.items()):
        at = (F.col("__size") - 1) * F.lit(float(q))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)


def column_quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact quantile of several numeric columns; None for a column without values."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "__col", "__v"
    )
    found = exact_quantiles(long, ["__col"], "__v", {"q": q}).collect()
    by_name = {r["__col"]: r["q"] for r in found}
    return {c: by_name.get(c) for c in columns}
