"""Cleaning, encoding, imputation, label binarisation and feasibility checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.ratios import INF
from evenkeel.functions.recode import to_number
from evenkeel.operators.lineage import cut_lineage
from evenkeel.operators.ordering import column_quantiles, take_per_group
from evenkeel.roles import numeric_columns

#: Columns with more categories than this are encoded as one sparse vector, unless the caller sets another limit.
MAX_CATEGORIES = 10_000


class NonFiniteError(ArithmeticError):
    """A numeric column contains NULL, NaN or an infinity where none may be."""


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def sample_fraction(df: DataFrame, row_id: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * n) rows without replacement; all rows from 1.0 up."""
    if fraction >= 1.0:
        return df
    return take_per_group(df, [], row_id, round(fraction * df.count()), seed)


def drop_unlabelled(df: DataFrame, target: str | None) -> DataFrame:
    """Rows whose target is not NULL."""
    return df.dropna(subset=[target]) if target in df.columns else df


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value, found in one aggregation."""
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if not seen[c]]


def minimal_clean(df: DataFrame, target: str | None) -> DataFrame:
    """Drop unlabelled rows, then columns that are NULL in all remaining rows."""
    kept = drop_unlabelled(df, target)
    return kept.drop(*empty_columns(kept))


def text_columns(df: DataFrame, *exclude: str) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``name, value`` of all columns, in one pass over the rows."""
    return df.select(*columns).unpivot([], columns, "name", "value").filter(F.col("value").isNotNull()).distinct()


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of every column, on the driver."""
    values: dict[str, list[str]] = {c: [] for c in columns}
    for r in _pairs(df, columns).collect() if columns else []:
        values[r["name"]].append(r["value"])
    return {c: sorted(v) for c, v in values.items()}


def one_hot_vector(df: DataFrame, columns: list[str], out: str = "encoded") -> DataFrame:
    """Replace text columns by one sparse vector: a place per category but the first of each column, in order.

    The places are a table: ranges of values are numbered apart and their sizes summed, so neither the driver nor one
    task holds all values. NULL has no place.
    """
    number = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])[F.col("name")]
    parts = _pairs(df, columns).select(number.alias("__c"), "value").repartitionByRange("__c", "value")
    parts = cut_lineage(parts.withColumn("__part", F.spark_partition_id()))
    before, total = {}, 0
    for part, n in sorted(parts.groupBy("__part").count().collect()):  # one number a range
        before[part], total = total, total + n
    firsts = {r["__c"]: r["v"] for r in parts.groupBy("__c").agg(F.min("value").alias("v")).collect()}
    shown = sum(1 for _ in firsts)
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    place = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy("__c", "value")) - 1
    places = cut_lineage(parts.join(F.broadcast(starts), "__part").select("__c", "value", place.alias("__at")))
    rows = df
    for i, c in enumerate(columns):
        skipped = sum(1 for k in firsts if k <= i)
        mine = places.filter((F.col("__c") == i) & (F.col("value") != F.lit(firsts.get(i))))
        mine = mine.select(F.col("value").alias(f"__v{i}"), (F.col("__at") - skipped).cast("int").alias(f"__at{i}"))
        rows = rows.join(mine, F.col(f"`{c}`") == F.col(f"__v{i}"), "left")
    at = F.array_compact(F.array(*[f"__at{i}" for i in range(len(columns))]))
    sparse = F.struct(
        F.lit(0).alias("type"), F.lit(total - shown).alias("size"), at.alias("indices"), F.transform(at, lambda x: F.lit(1.0)).alias("values")
    )
    read = F.from_json(F.to_json(F.struct(sparse.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]
    return rows.select(*[f"`{c}`" for c in df.columns if c not in columns], read.alias(out))


def dummy_columns(name: str, values: list[str]) -> dict[str, Column]:
    """Boolean indicator per category but the first; NULL is false everywhere."""
    return {
        f"{name}_{v}": F.coalesce(F.col(name) == F.lit(v), F.lit(False)) for v in values[1:]
    }


def one_hot(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> DataFrame:
    """Replace text columns by their dummies, appended after the other columns.

    Columns of more than ``limit`` categories become one sparse vector, ``encoded``, at the end.
    """
    sizes = dict(_pairs(df, columns).groupBy("name").count().collect()) if columns else {}
    many = [c for c in columns if sizes.get(c, 0) > limit]
    values = categories(df, [c for c in columns if c not in many])
    dummies = {k: v for c in values for k, v in dummy_columns(c, values[c]).items()}
    rest = [F.col(c) for c in df.columns if c not in values]
    wide = df.select(*rest, *[v.alias(k) for k, v in dummies.items()])
    return one_hot_vector(wide, many) if many else wide


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs of numeric columns with the exact column median; columns become double."""
    medians = column_quantiles(df, columns)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double"))
        for c in columns
    }
    return df.withColumns(filled) if filled else df


def encode_and_impute(df: DataFrame, row_id: str, protected: str | None = None, limit: int = MAX_CATEGORIES) -> DataFrame:
    """One-hot text columns and impute numeric ones; the protected column is kept, last."""
    kept = [c for c in (protected,) if c and c in df.columns]
    encoded = one_hot(df, text_columns(df, row_id, *kept), limit)
    filled = median_impute(encoded, numeric_columns(encoded, row_id, *kept))
    return filled.select(*[c for c in filled.columns if c not in kept], *kept)


# ------------------------------------------------------------------------ label rules


def binarize_values(df: DataFrame, target: str, positive: Iterable) -> DataFrame:
    """Membership in ``positive`` to 1, everything else (NULL too) to 0."""
    hit = F.coalesce(F.col(target).isin(*positive), F.lit(False))
    return df.withColumn(target, hit.cast("int"))


def binarize_threshold(df: DataFrame, target: str, threshold: float) -> DataFrame:
    """Numbers from ``threshold`` up to 1, everything else (text, NULL) to 0."""
    hit = F.coalesce(to_number(F.col(target)) >= F.lit(float(threshold)), F.lit(False))
    return df.withColumn(target, hit.cast("int"))


def label_values(df: DataFrame, target: str, order: str, most: int = 3) -> list:
    """Up to ``most`` distinct non-NULL labels, in order of first appearance by ``order``."""
    return [
        r[target]
        for r in df.filter(F.col(target).isNotNull())
        .groupBy(target)
        .agg(F.min(order).alias("__first"))
        .orderBy("__first", target)
        .limit(most)
        .collect()
    ]


def binarize_median(df: DataFrame, target: str) -> DataFrame:
    """At or above the exact median to 1; NULL to 0."""
    cut = column_quantiles(df, [target])[target]
    hit = F.coalesce(F.col(target) >= F.lit(cut), F.lit(False))
    return df.withColumn(target, hit.cast("int"))


def map_pair(df: DataFrame, target: str, pair: list) -> DataFrame:
    """First value of ``pair`` to 0, second to 1, NULL stays NULL."""
    col = F.col(target)
    mapped = F.when(col == F.lit(pair[0]), F.lit(0)).when(col == F.lit(pair[1]), F.lit(1))
    return df.withColumn(target, mapped)


def binarize_target(
    df: DataFrame,
    target: str,
    order: str,
    positive: Iterable | None = None,
    threshold: float | None = None,
    mode: str = "sorted",
) -> DataFrame:
    """Binary label by the first rule that applies.

    Listed values, a threshold, a median split (numeric, more than two values), or the two
    distinct values. ``mode='first_seen'`` maps whichever value comes first by ``order``
    to 0, even for labels already 0/1; ``mode='sorted'`` maps the smaller value to 0, so
    re-ordering rows cannot flip the label. Other targets are returned unchanged.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in table")
    if positive is not None:
        return binarize_values(df, target, positive)
    if threshold is not None:
        return binarize_threshold(df, target, threshold)
    seen = label_values(df, target, order)
    if is_numeric(df, target) and len(seen) > 2:
        return binarize_median(df, target)
    if len(seen) == 2:
        return map_pair(df, target, seen if mode == "first_seen" else sorted(seen))
    return df


def prepare_model(
    df: DataFrame,
    target: str,
    row_id: str,
    protected: str | None = None,
    binarize: bool = True,
    mode: str = "sorted",
    limit: int = MAX_CATEGORIES,
) -> DataFrame:
    """Clean, binarise the label, encode text and impute: a numeric, model-ready table.

    A text label of more than two values cannot be learnt and raises ``ValueError``.
    """
    ready = minimal_clean(df, target)
    if binarize:
        ready = binarize_target(ready, target, row_id, mode=mode)
        if ready.schema[target].dataType.typeName() == "string" and ready.select(target).distinct().limit(3).count() > 2:
            raise ValueError(f"label {target!r} is text of more than two values")
    return encode_and_impute(ready, row_id, protected, limit)


# ------------------------------------------------------------------------------ checks


def non_finite(col: Column) -> Column:
    value = col.cast("double")
    return F.coalesce(F.isnan(value) | (F.abs(value) == INF), F.lit(True)) | col.isNull()


def non_finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: how many NULL, NaN or infinite values it holds."""
    counts = df.agg(*[F.count_if(non_finite(F.col(c))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_bad")


def require_finite(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Return ``df``, or raise with the number of non-finite values."""
    if columns:
        bad = df.agg(*[F.count_if(non_finite(F.col(c))).alias(c) for c in columns]).first()
        n_bad = sum(bad)
        if n_bad:
            raise NonFiniteError(f"{what}: {n_bad} non-finite value(s)")
    return df


def clean_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce metric columns to finite doubles; anything else becomes NULL."""

    def cleaned(name: str) -> Column:
        number = to_number(F.col(name))
        return F.when(F.abs(number) != INF, number)

    return df.withColumns({c: cleaned(c) for c in columns})


def target_feasibility(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Per group: can this label be learnt, and if not, why.

    Infeasible without labels, with a single class, or when a pair of labels other than
    0/1 has to be mapped while some labels are NULL.
    """
    col = F.col(target).cast("double")
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count(target).alias("n_labels"),
        F.count_distinct(col).alias("n_classes"),
        F.min(col).alias("__min"),
        F.max(col).alias("__max"),
    )
    plain = (F.col("__min") == 0) & (F.col("__max") == 1)
    unmapped = (F.col("n_classes") == 2) & ~plain & (F.col("n_labels") < F.col("n_rows"))
    reason = (
        F.when(F.col("n_labels") == 0, "no labels")
        .when(F.col("n_classes") == 1, "single class")
        .when(unmapped, "missing labels")
    )
    return stats.select(
        *keys,
        "n_rows",
        "n_labels",
        "n_classes",
        reason.isNull().alias("feasible"),
        F.coalesce(reason, F.lit("ok")).alias("reason"),
    )


def unpivot_methods(
    df: DataFrame, ids: list[str], columns: dict[str, str], value: str
) -> DataFrame:
    """Wide metric columns to rows (ids, method, value) under display names."""
    long = df.unpivot(ids, list(columns), "method", value)
    names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return long.withColumn("method", names[F.col("method")])


def pivot_mean(
    df: DataFrame, keys: list[str], column: str, values: list[str], metrics: list[str]
) -> DataFrame:
    """Rows to columns ``<metric>_<value>`` holding means; the value list is explicit."""
    wide = df.groupBy(*keys).agg(
        *[
            F.avg(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{v}")
            for m in metrics
            for v in values
        ]
    )
    return wide
