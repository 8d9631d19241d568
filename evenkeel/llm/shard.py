"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 24
#: Source partitions of the draw: at least so many, and more once they would hold over so many rows each.
SOURCES, ROWS_PER_SOURCE = 1024, 1_000_000


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of source i that go to shard j, for a uniform shuffle of all rows.

    Shard sizes differ by one at most. Source by source, the counts are drawn without replacement from the room
    that is left in the shards (multivariate hypergeometric), so row and column sums are exact.
    """
    total = sum(counts)
    room = np.array([total // shards + (j < total % shards) for j in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        left = n
        rest = int(room.sum())
        for j in range(shards):  # one hypergeometric draw a cell; its method has no limit on the sums
            rest -= int(room[j])
            k = _hypergeometric(rng, int(room[j]), rest, left)
            matrix[i, j] = k
            left -= k
        room -= matrix[i]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 1_000_000_000:  # the generator's own bound
        return int(rng.hypergeometric(good, bad, sample))
    return _inverted(rng, good, bad, sample)


def _inverted(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw by inversion: weights relative to the mode's, by the ratios of neighbours.

    Weights beyond 40 deviations and 200 values from the mode are under the least double.
    """
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    variance = sample * good / (good + bad) * bad / (good + bad) * (good + bad - sample) / (good + bad - 1)
    reach = int(40 * variance**0.5) + 200
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) / (up + 1) * ((sample - up) / (bad - sample + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - sample + down) / (sample - down + 1)))
    sums = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    at = int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))
    return mode - len(below) + min(at, len(sums) - 1)


def uniform_shards(docs: DataFrame, key: list[Column], shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within a shard), a uniform shuffle.

    ``key`` names columns that tell rows apart; rows equal in all of them may trade places. Nulls are values.
    Rows are dealt to sources by a hash, so a hot source or text has no effect; each source is permuted by a hash
    order, cut by its row of the matrix, and each shard is permuted again in cells of bounded size. The driver holds
    one count per source and shard, never rows. An empty table gives an empty table. Columns of ``docs`` named like
    the internal ones are not touched: those start with ``__``, and a clash raises an error.
    """
    clash = {c for c in docs.columns if c in {"shard", "slot"} or c.startswith("__sh_")}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result")
    spark = docs.sparkSession
    mix = F.xxhash64(F.lit(seed), *key)
    again = F.xxhash64(F.lit(seed + 1), *key)
    total = docs.count()
    sources = max(SOURCES, -(-total // ROWS_PER_SOURCE))
    rows = docs.withColumns({"__sh_mix": mix, "__sh_again": again}).withColumn(
        "__sh_source", F.pmod(F.xxhash64(F.lit(seed + 2), "__sh_mix"), F.lit(sources)).cast("int")
    )
    counts = dict(rows.groupBy("__sh_source").count().collect())  # one number a source
    matrix = draw_matrix([counts.get(i, 0) for i in range(sources)], shards, seed)
    ends = matrix.cumsum(axis=1)
    cuts = spark.createDataFrame(
        [(i, [int(x) for x in ends[i]]) for i in range(sources)], "__sh_source int, __sh_ends array<bigint>"
    )
    place = F.row_number().over(W.partitionBy("__sh_source").orderBy("__sh_mix", *key)) - 1
    sent = (
        rows.withColumn("__sh_place", place)
        .join(cuts, "__sh_source")
        .withColumn("shard", F.size(F.filter("__sh_ends", lambda x: x <= F.col("__sh_place"))).cast("int"))
    )
    cells = max(1, SOURCES // shards + 1, -(-total // (shards * ROWS_PER_SOURCE)))
    cell = F.shiftright(F.shiftrightunsigned("__sh_again", 33) * F.lit(cells), 31).cast("int")
    sent = sent.withColumn("__sh_cell", cell)
    sizes = sent.groupBy("shard", "__sh_cell").agg(F.count("*").alias("__sh_n"))
    before = F.coalesce(F.sum("__sh_n").over(W.partitionBy("shard").orderBy("__sh_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "__sh_cell", before.alias("__sh_before"))
    within = F.row_number().over(W.partitionBy("shard", "__sh_cell").orderBy("__sh_again", *key)) - 1
    return (
        sent.withColumn("__sh_within", within)
        .join(offsets, ["shard", "__sh_cell"])
        .withColumn("slot", F.col("__sh_before") + F.col("__sh_within"))
        .select(*docs.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Per document its size, CRC-32, shard and slot under the law ``rows``.

    A null text has no bytes (size 8, CRC-32 of nothing, 0). ``grown_shard`` is null under this law.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = uniform_shards(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
