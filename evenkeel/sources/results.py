"""The table of finished runs: uniform rows, success/failure split, output check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.lineage import cut_lineage
from evenkeel.sources.tables import RUN_RESULTS

RESULT_COLUMNS = RUN_RESULTS.fieldNames()

#: Columns that only a successful run fills in.
OUTCOME = ["techniques", "model_used", "fitness", "fairness_score", "performance_score"]


def result_rows(runs: DataFrame, error: str = "error") -> DataFrame:
    """The fixed result columns plus ``error``; failed runs have NULL outcomes.

    A run without ``model_used`` reports its own model.
    """
    ok = F.col(error).isNull()
    types = {f.name: f.dataType for f in RUN_RESULTS.fields}

    def field(name: str) -> Column:
        value = F.col(name) if name in runs.columns else F.lit(None)
        if name == "model_used":
            value = F.coalesce(value, F.col("model_identifier"))
        if name in OUTCOME:
            value = F.when(ok, value)
        return value.cast(types[name]).alias(name)

    return runs.select(*[field(c) for c in RESULT_COLUMNS], F.col(error).cast("string").alias("error"))


def split_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes without the error column, failures)."""
    return (
        rows.filter(F.col("error").isNull()).drop("error"),
        rows.filter(F.col("error").isNotNull()),
    )


def count_results(rows: DataFrame) -> DataFrame:
    """One row: how many runs succeeded and failed."""
    return rows.agg(
        F.count_if(F.col("error").isNull()).alias("n_success"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
    )


def record_results(rows: DataFrame, results_path: str, errors_path: str) -> tuple[int, int]:
    """Append successes and failures to their tables; returns (n_success, n_error).

    ``rows`` are made once, however costly, and written and counted from the shared folder.
    """
    rows = cut_lineage(rows)
    good, bad = split_results(rows)
    good.write.mode("append").parquet(results_path)
    bad.write.mode("append").parquet(errors_path)
    counts = count_results(rows).first()
    return counts["n_success"], counts["n_error"]


def validate_output(
    results: DataFrame, errors: DataFrame, expected: int = len(RESULT_COLUMNS)
) -> DataFrame:
    """One row: result rows, columns, error entries, and whether the output is acceptable."""
    n_cols = F.lit(len(results.columns)).cast("bigint")
    both = results.select(F.lit(1).alias("r"), F.lit(0).alias("e")).unionAll(
        errors.select(F.lit(0).alias("r"), F.lit(1).alias("e"))
    )
    return both.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_err"),
    ).select(
        "n_rows",
        n_cols.alias("n_cols"),
        "n_err",
        ((F.col("n_rows") >= 1) & (n_cols == expected)).alias("ok"),
    )
