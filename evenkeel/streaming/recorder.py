"""Append finished runs to the result tables while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.lineage import cut_lineage
from evenkeel.sources.results import split_results


def record_stream(
    rows: DataFrame, results_path: str, errors_path: str, checkpoint: str
) -> StreamingQuery:
    """Write a stream of result rows: successes to one table, failures to another.

    Each batch overwrites its own sub-folder, so a batch replayed after a failure does not
    duplicate rows. Runs until the available input is used up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_results(cut_lineage(batch))
        good.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{errors_path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
