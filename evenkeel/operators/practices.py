"""The eight data-preparation practices and their ordered application.

Every practice is a function (table, roles) -> table. Fitted statistics come from one
aggregation; rows are then changed by a projection, a filter or a keyed join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash32, hash60
from evenkeel.operators.joins import attach, explode_range, keyed_join
from evenkeel.operators.lineage import cut_lineage
from evenkeel.operators.ordering import hash_rank, take_per_group
from evenkeel.roles import Roles, numeric_columns

SEED_STRATIFIED = 42
SEED_RESAMPLE = 123
SEED_SHUFFLE = 42

#: A drawn row serves at most about this many draws in one task.
DRAWS_PER_COPY = 10_000


# ---------------------------------------------------------------------------- scaling


def standard(df: DataFrame, roles: Roles, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Z-scores (population deviation) of all numeric columns but the protected one.

    The target is scaled too unless excluded. A constant column becomes 0. The protected
    column moves to the end.
    """
    cols = numeric_columns(df, roles.row_id, roles.protected, *exclude)
    if cols:
        stats = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        ).first()
        df = df.withColumns(
            {
                c: (F.col(c) - F.lit(stats[f"m_{c}"]).cast("double"))
                / F.lit(stats[f"s_{c}"] or 1.0)
                for c in cols
            }
        )
    tail = [c for c in (roles.protected,) if c in df.columns]
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def min_max_scaling(df: DataFrame, roles: Roles, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All numeric columns, protected and target included, to [0, 1]; a constant to 0."""
    cols = numeric_columns(df, roles.row_id, *exclude)
    if not cols:
        return df
    stats = df.agg(
        *[F.min(c).cast("double").alias(f"l_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"h_{c}") for c in cols],
    ).first()

    def scaled(c: str) -> Column:
        low, high = stats[f"l_{c}"], stats[f"h_{c}"]
        span = (high - low) if low is not None else 0.0
        return (F.col(c).cast("double") - F.lit(low).cast("double")) / F.lit(span or 1.0)

    return df.withColumns({c: scaled(c) for c in cols})


# --------------------------------------------------------------------------- sampling


def group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, column: str) -> Row:
    """Smallest and largest group, all rows, and NULL groups (not allowed), in one pass."""
    if column not in df.columns:
        raise ValueError(f"protected column {column!r} not in table")
    sizes = (
        group_counts(df, [column])
        .agg(
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
            F.sum("n").alias("total"),
            F.count_if(F.col(column).isNull()).alias("nulls"),
        )
        .first()
    )
    if sizes["nulls"]:
        raise ValueError(f"protected column {column!r} contains NULL")
    return sizes


def _equal_groups(df: DataFrame, roles: Roles, seed: int) -> DataFrame:
    smallest = group_sizes(df, roles.protected)["smallest"]
    return take_per_group(df, [roles.protected], roles.row_id, smallest or 0, seed)


def stratified_sampling(df: DataFrame, roles: Roles, seed: int = SEED_STRATIFIED) -> DataFrame:
    """Every protected group cut to the size of the smallest; rows without group vanish."""
    if roles.protected not in df.columns:
        return df.limit(0)
    return _equal_groups(df.filter(F.col(roles.protected).isNotNull()), roles, seed)


def undersampling(df: DataFrame, roles: Roles, seed: int = SEED_RESAMPLE) -> DataFrame:
    """Like stratified sampling, but a missing column or a NULL group is an error."""
    return _equal_groups(df, roles, seed)


def draw_with_replacement(
    df: DataFrame, keys: list[str], row_id: str, draws: DataFrame, seed: int | str
) -> DataFrame:
    """Draw rows of each group with replacement.

    ``draws`` holds (keys, n, n_draws): the group's size and how many rows to draw. Draw
    ``i`` takes the row whose hash rank is hash(seed, keys, i) mod n. The drawn row gets
    the identifier ``<row_id>#<i>``. Rows that serve many draws are copied so that no join
    key collects more than about ``DRAWS_PER_COPY`` of them. The draws are made from a few rows, so the planner takes
    them for small; the join is always a shuffled one, since a broadcast would pass all of them through the driver.
    """
    copies = F.ceil(F.col("n_draws") / (F.col("n") * DRAWS_PER_COPY)).cast("bigint")
    wanted = explode_range(
        draws.filter("n > 0").withColumn("__copies", copies), F.col("n_draws"), "__i"
    )
    wanted = wanted.select(
        *keys,
        "__i",
        (1 + F.pmod(hash60(seed, *keys, "__i"), F.col("n"))).alias("__rank"),
        F.pmod(F.col("__i"), F.col("__copies")).alias("__copy"),
    )
    sizes = draws.filter("n > 0 and n_draws > 0").select(*keys, "n", copies.alias("__copies"))
    ranked = attach(
        hash_rank(df, keys, row_id, f"{seed}:rank", "__rank"), sizes, keys, "n", F.col(row_id)
    )
    pool = ranked.withColumn(
        "__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1))
    )
    hit = keyed_join(pool.hint("merge"), wanted, [*keys, "__rank", "__copy"])
    new_id = F.concat(F.col(row_id).cast("string"), F.lit("#"), F.col("__i").cast("string"))
    return hit.select(*[new_id.alias(c) if c == row_id else F.col(c) for c in df.columns])


def oversampling(df: DataFrame, roles: Roles, seed: int = SEED_RESAMPLE) -> DataFrame:
    """Every protected group drawn anew, with replacement, to the size of the largest."""
    largest = group_sizes(df, roles.protected)["largest"] or 0
    draws = group_counts(df, [roles.protected]).withColumn("n_draws", F.lit(largest).cast("bigint"))
    return draw_with_replacement(df, [roles.protected], roles.row_id, draws, seed)


# ------------------------------------------------------------------- derived columns


def ipw(df: DataFrame, roles: Roles, out: str = "Weight") -> DataFrame:
    """Append the inverse share of the row's protected group as a feature."""
    total = group_sizes(df, roles.protected)["total"] or 0
    weights = group_counts(df, [roles.protected]).select(
        roles.protected, "n", (F.lit(float(total)) / F.col("n")).alias(out)
    )
    return attach(df, weights, [roles.protected], "n", F.col(roles.row_id)).select(
        *[c for c in df.columns if c != out], out
    )


def clustering(
    df: DataFrame, roles: Roles, n_clusters: int = 2, seed: int = 42, out: str = "Cluster"
) -> DataFrame:
    """Append the k-means cluster over all numeric columns, target and protected included.

    A table without rows gets the column and nothing else.
    """
    if df.isEmpty():
        return df.withColumn(out, F.lit(None).cast("int"))
    cols = numeric_columns(df, roles.row_id)
    features = VectorAssembler(inputCols=cols, outputCol="__features", handleInvalid="error")
    model = KMeans(
        k=n_clusters, seed=seed, featuresCol="__features", predictionCol=out
    ).fit(features.transform(df))
    return model.transform(features.transform(df)).drop("__features")


def squared_distance(columns: list[str], centre: list[float]) -> Column:
    total = F.lit(0.0)
    for name, value in zip(columns, centre):
        total = total + F.pow(F.col(name).cast("double") - F.lit(float(value)), 2)
    return total


def assign_to_centroids(
    df: DataFrame, columns: list[str], centres: list[list[float]], out: str = "Cluster"
) -> DataFrame:
    """Append the 0-based number of the nearest centre (ties: the first)."""
    options = F.array(
        *[
            F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("i"))
            for i, c in enumerate(centres)
        ]
    )
    return df.withColumn(out, F.array_min(options)["i"])


def centroid_step(
    df: DataFrame, columns: list[str], centres: list[list[float]]
) -> DataFrame:
    """One refinement step: the mean of the rows nearest to every centre."""
    return (
        assign_to_centroids(df, columns, centres)
        .groupBy("Cluster")
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    )


def shuffle_key(df: DataFrame, roles: Roles, seed: int = SEED_SHUFFLE) -> DataFrame:
    """Append the random order key of each row; sort by it only where rows are written."""
    return df.withColumn("shuffle_key", hash32(seed, roles.row_id))


def matching(df: DataFrame, roles: Roles, seed: int = SEED_SHUFFLE) -> DataFrame:
    """A random permutation of the rows.

    A Spark table is an unordered set, so the rows are returned as they are; use
    :func:`shuffle_key` to write them in the permuted order.
    """
    return df


PRACTICES: dict[str, Callable[[DataFrame, Roles], DataFrame]] = {
    "standard": standard,
    "stratified_sampling": stratified_sampling,
    "oversampling": oversampling,
    "undersampling": undersampling,
    "clustering": clustering,
    "ipw": ipw,
    "matching": matching,
    "min_max_scaling": min_max_scaling,
}

#: Practices whose result is written to the checkpoint folder inside a longer list.
CUT_AFTER = {"stratified_sampling", "oversampling", "undersampling", "clustering"}


def apply_practice(df: DataFrame, name: str, roles: Roles) -> DataFrame:
    """Apply one practice; an unknown name changes nothing."""
    practice = PRACTICES.get(name)
    return practice(df, roles) if practice else df


def apply_practices(
    df: DataFrame, names: str | list[str] | tuple[str, ...] | None, roles: Roles
) -> DataFrame:
    """Apply practices left to right; a failing practice stops the whole list."""
    steps = [names] if isinstance(names, str) and names else list(names or [])
    for i, name in enumerate(steps):
        df = apply_practice(df, name, roles)
        if name in CUT_AFTER and i + 1 < len(steps):
            df = cut_lineage(df)
    return df
