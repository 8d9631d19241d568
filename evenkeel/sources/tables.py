"""Reading tables with declared schemas, and the schemas of the experiment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns of the experiment files, as these name them.
DIAGNOSIS = T.StructType(
    [
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("cp", T.IntegerType()),
        T.StructField("trestbps", T.IntegerType()),
        T.StructField("chol", T.IntegerType()),
        T.StructField("fbs", T.IntegerType()),
        T.StructField("restecg", T.IntegerType()),
        T.StructField("thalach", T.IntegerType()),
        T.StructField("exang", T.IntegerType()),
        T.StructField("oldpeak", T.DoubleType()),
        T.StructField("slope", T.IntegerType()),
        T.StructField("ca", T.IntegerType()),
        T.StructField("thal", T.IntegerType()),
        T.StructField("num", T.IntegerType()),
    ]
)

RUN_RESULTS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("model_identifier", T.StringType()),
        T.StructField("protected_attribute", T.StringType()),
        T.StructField("population_size", T.IntegerType()),
        T.StructField("generations", T.IntegerType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("techniques", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("fitness", T.DoubleType()),
        T.StructField("fairness_score", T.DoubleType()),
        T.StructField("performance_score", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]
)

METHOD_RESULTS = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("protected_attribute", T.StringType()),
        T.StructField("model_identifier", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("performance_score", T.DoubleType()),
        T.StructField("fairness_score", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

#: All fields are read as text: numbers are parsed, and checked, by the score store.
RAW_SCORES = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("protected_attribute", T.StringType()),
        T.StructField("target_column", T.StringType()),
        T.StructField("techniques", T.StringType()),
        T.StructField("fitness", T.StringType()),
        T.StructField("fairness", T.StringType()),
        T.StructField("performance", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)

#: Our own store files: those of the archive with all the parts of the key.
STORED_SCORES = T.StructType(
    [
        *RAW_SCORES.fields,
        T.StructField("dataset", T.StringType()),
        T.StructField("perf_weight", T.StringType()),
        T.StructField("fair_weight", T.StringType()),
    ]
)


def load_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A CSV file with a header, or Parquet, as a table.

    Declare ``schema`` for CSV in production; without it types are inferred by an extra
    pass over the file. ``columns`` narrows what is read.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        # doubled quotes inside a field are plain quotes, as in RFC 4180
        reader = spark.read.option("header", True).option("escape", '"').option("nanValue", "NaN")
        df = (
            reader.schema(schema).csv(path)
            if schema
            else reader.option("inferSchema", True).csv(path)
        )
    return df.select(*columns) if columns else df
