"""The score store: results of evaluated practice lists, kept as a table.

A stored score is reused only for the identical dataset, model, attribute, target, weights
and *ordered* list of practices.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.joins import attach
from evenkeel.roles import INFEASIBLE

WEIGHTS = ["perf_weight", "fair_weight"]
SCORE_KEYS = ["dataset", "model", "protected_attribute", "target_column", "techniques", *WEIGHTS]
#: Weight of either part of a score in tables that do not name it.
EQUAL_WEIGHT = 0.5
SCORES = ["fitness", "fairness", "performance"]
#: Column of a compacted store that its buckets are made by.
KEY_HASH = "key_hash"


def with_weights(df: DataFrame) -> DataFrame:
    """``df`` with both weight columns; a table without them was scored with equal weights."""
    return df.withColumns({w: F.lit(EQUAL_WEIGHT) for w in WEIGHTS if w not in df.columns})


def technique_key(col: Column) -> Column:
    """NULL becomes the empty list; order is kept."""
    return F.coalesce(col, F.array().cast("array<string>"))


def single_technique(col: Column) -> Column:
    """A single name becomes a one-element list; NULL or '' the empty list."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array(col)
    )


def parse_number(col: Column) -> Column:
    """Empty text is NULL; text that is no number stops the job."""
    text = F.trim(col)
    parsed = text.try_cast("double")
    problem = F.raise_error(F.concat(F.lit("score store: not a number: "), text)).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("double")).when(
        parsed.isNull(), problem
    ).otherwise(parsed)


def parse_techniques(col: Column) -> Column:
    """JSON array text as a list; NULL or '' is the empty list, malformed text stops the job."""
    text = F.coalesce(col, F.lit(""))
    parsed = F.from_json(col, "array<string>")
    problem = F.raise_error(F.concat(F.lit("score store: not a list: "), text)).cast("array<string>")
    return F.when(text == "", F.array().cast("array<string>")).when(
        parsed.isNull(), problem
    ).otherwise(parsed)


def load_scores(raw: DataFrame, order: str, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Parse stored text rows; of rows with the same key the last by ``order`` counts.

    A NaN fitness is read as infeasible; NaN in the other scores as NULL.
    """

    def score(name: str) -> Column:
        number = parse_number(F.col(name))
        other = F.lit(INFEASIBLE) if name == "fitness" else F.lit(None).cast("double")
        return F.when(F.isnan(number), other).otherwise(number)

    weights = {w: parse_number(F.col(w).cast("string")) for w in WEIGHTS if w in keys}
    parsed = with_weights(raw).withColumns(
        {"techniques": parse_techniques(F.col("techniques")), **{s: score(s) for s in SCORES}, **weights}
    )
    # one aggregate per number: their buffers are of fixed width, so rows are hashed and not sorted
    return parsed.groupBy(*keys).agg(*[F.max_by(s, order).alias(s) for s in SCORES])


def store_rows(scored: DataFrame, timestamp: Column, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Rows in stored text form: practices as compact JSON, missing scores as ''."""
    return with_weights(scored).select(
        timestamp.cast("string").alias("timestamp"),
        *[F.col(k) for k in keys if k != "techniques"],
        F.to_json(technique_key(F.col("techniques"))).alias("techniques"),
        *[F.coalesce(F.col(s).cast("string"), F.lit("")).alias(s) for s in SCORES],
        F.lit("").alias("extra"),
    )


def append_scores(scored: DataFrame, path: str) -> None:
    """Append to a store laid out for pruning by dataset, attribute and model."""
    store_rows(scored, F.current_timestamp()).write.mode("append").partitionBy(
        "dataset", "protected_attribute", "model"
    ).parquet(path)


def _usable(store: DataFrame, keys: list[str], name: str) -> DataFrame:
    return with_weights(store).filter(F.col("fitness").isNotNull()).select(
        *keys, F.struct(*SCORES).alias(name)
    )


def score_misses(
    requests: DataFrame, stores: list[DataFrame], keys: list[str] = SCORE_KEYS
) -> DataFrame:
    """Distinct requested keys that no store can answer (a NULL fitness is no answer)."""
    missing = with_weights(requests).select(*keys).distinct()
    for i, store in enumerate(stores):
        known = _usable(store, keys, f"__{i}")
        missing = missing.join(known, keys, "left_anti")
    return missing


def score_lookup(
    requests: DataFrame,
    runtime: DataFrame,
    archive: DataFrame | None,
    spread: str,
    keys: list[str] = SCORE_KEYS,
) -> DataFrame:
    """Add stored scores to requests: the runtime store first, then the archive.

    Without ``archive`` (a reset) only the runtime store answers. Each distinct key is
    looked up once, so a list requested by very many rows does not skew the join; only
    keys with an answer are attached to the requests.
    """
    asked, requests = requests.columns, with_weights(requests)
    wanted = requests.groupBy(*keys).agg(F.count("*").alias("__n"))
    if archive is None:
        found, best = wanted.join(_usable(runtime, keys, "__r"), keys), F.col("__r")
    else:
        found = wanted.join(_usable(runtime, keys, "__r"), keys, "left").join(_usable(archive, keys, "__a"), keys, "left")
        best = F.coalesce("__r", "__a")
    scored = found.filter(best.isNotNull()).select(*keys, "__n", *[best[s].alias(s) for s in SCORES])
    return attach(requests, scored, keys, "__n", F.col(spread), "left").select(*asked, *SCORES)


def compact_scores(raw: DataFrame, order: str, name: str, path: str, buckets: int, keys: list[str] = SCORE_KEYS) -> None:
    """Write the last row of every key of ``raw`` as table ``name`` in ``path``, bucketed and sorted by a hash of the key.

    The table replaces an older one of that name, so ``raw`` must not be read from it. A look-up in it by
    :func:`lookup_compacted` moves requested keys only. Take as many buckets as keep one of them in a task's memory.
    """
    rows = load_scores(raw, order, keys).withColumn(KEY_HASH, F.xxhash64(*keys))
    # one task a bucket, so a bucket is one file
    placed = rows.repartition(buckets, KEY_HASH).write.mode("overwrite").option("path", path)
    placed.bucketBy(buckets, KEY_HASH).sortBy(KEY_HASH).saveAsTable(name)


def lookup_compacted(requests: DataFrame, name: str, spread: str, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Add the scores of table ``name``, written by :func:`compact_scores`, to requests; NULL where it has none.

    The buckets are joined where they lie: the distinct requested keys go to them, the store is not shuffled. Keys of
    equal hash are told apart by their columns. Requests of one key are counted before, so none is hot. A NULL key
    column matches nothing.
    """
    asked, requests = requests.columns, with_weights(requests)
    wanted = requests.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn(KEY_HASH, F.xxhash64(*keys))
    store = requests.sparkSession.table(name).filter(F.col("fitness").isNotNull())
    stored = store.select(KEY_HASH, F.struct(*keys).alias("__key"), *SCORES)
    met = wanted.join(stored.hint("merge"), KEY_HASH)
    # not a part of the join's condition: the join would then ask for a shuffle by these columns, too
    same = reduce(and_, [F.col(f"__key.{k}") == F.col(k) for k in keys])
    picked = met.select(*keys, "__n", *[F.when(same, F.struct(*SCORES)).alias("__s")])
    scored = picked.groupBy(*keys).agg(F.max("__n").alias("__n"), F.max("__s").alias("__s")).filter("__s is not null")
    return attach(requests, scored.select(*keys, "__n", "__s.*"), keys, "__n", F.col(spread), "left").select(*asked, *SCORES)
