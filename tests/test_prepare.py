import math

import pytest

from evenkeel.functions import recode
from evenkeel.operators import clean


def rows(df, *cols, key="id"):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(key).collect()]


def test_minimal_clean_drops_unlabelled_rows_then_empty_columns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, 1), (2, 2.0, None, None), (3, 3.0, None, 0)], "id int, a double, empty double, y int"
    )
    out = clean.minimal_clean(df, "y")
    assert out.columns == ["id", "a", "y"]
    assert rows(out, "a") == [1.0, 3.0]


def test_column_emptied_by_row_drop_is_dropped(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 1)], "id int, a double, y int")
    assert clean.minimal_clean(df, "y").columns == ["id", "y"]


def test_encode_and_impute(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0, "x"), (2, 0, None, "y"), (3, 1, 3.0, "x")], "id int, sex int, num double, cat string"
    )
    out = clean.encode_and_impute(df, "id", "sex")
    assert out.columns == ["id", "num", "cat_y", "sex"]
    assert rows(out, "num") == [1.0, 2.0, 3.0]
    assert rows(out, "cat_y") == [False, True, False]


def test_one_hot_null_is_false_and_dots_are_fine(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, None), (3, "c.d")], "id int, c string")
    out = clean.one_hot(df, ["c"])
    assert [r["c_c.d"] for r in out.orderBy("id").collect()] == [False, False, True]


@pytest.mark.parametrize(
    "values,kind,options,expected",
    [
        (["yes", "no", "yes"], "string", {"positive": ["yes"]}, [1, 0, 1]),
        ([1, 2, 3], "int", {"threshold": 2}, [0, 1, 1]),
        ([1, 2, 3, 4], "int", {}, [0, 0, 1, 1]),
        (["b", "a", "b"], "string", {"mode": "first_seen"}, [0, 1, 0]),
        (["b", "a", "b"], "string", {}, [1, 0, 1]),
        ([1, 0, 1], "int", {"mode": "first_seen"}, [0, 1, 0]),
        ([1, 0, 1], "int", {}, [1, 0, 1]),
        (["1", "x", None], "string", {"threshold": 1}, [1, 0, 0]),
        (["a", "b", "c"], "string", {}, ["a", "b", "c"]),
    ],
)
def test_binarize_target(spark, values, kind, options, expected):
    df = spark.createDataFrame(list(enumerate(values)), f"id int, y {kind}")
    assert rows(clean.binarize_target(df, "y", "id", **options), "y") == expected


def test_binarize_needs_the_column(spark):
    with pytest.raises(ValueError):
        clean.binarize_target(spark.range(1), "y", "id")


def test_prepare_model_is_numeric(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "u", 1, "p"), (2, None, "v", 0, "n"), (3, 2.0, "u", 1, "p"), (4, 4.0, None, 0, None)],
        "id int, num double, cat string, sex int, y string",
    )
    out = clean.prepare_model(df, "y", "id", "sex")
    assert dict(out.dtypes) == {"id": "int", "num": "double", "cat_v": "boolean", "y": "double", "sex": "int"}
    assert rows(out, "y") == [1.0, 0.0, 1.0]


def test_income_codes_and_diagnosis(spark):
    income = spark.createDataFrame(
        [(1, ">50K", 1, 0, "1"), (2, "<=50K", 0, 1, "0"), (3, ">50K.", 1, 0, "1")],
        "id int, salary string, sex_Female int, sex_Male int, race string",
    )
    assert rows(recode.prepare_income(income), "salary", "sex", "race") == [(1, 1, 1), (0, 0, 0), (1, 1, 1)]
    credit = spark.createDataFrame(
        [(1, "A91", "30", 1), (2, "A92", "45", 2), (3, "A93", "22", 2), (4, "A95", "60", 1)],
        "id int, sex string, age string, Target int",
    )
    assert rows(recode.prepare_credit(credit), "sex", "age", "Target") == [
        (0, 30, 0), (1, 45, 1), (0, 22, 1), (1, 60, 0),
    ]
    heart = spark.createDataFrame(
        [(1, "1", "63", 0), (2, "0", "x", 1), (3, None, "41", 3), (4, "1", "50", 0)],
        "id int, sex string, age string, num int",
    )
    assert rows(recode.prepare_diagnosis(heart), "num") == [0, 1, 1, 0]
    assert rows(recode.prepare_diagnosis(heart), "age") == [63, None, 41, 50]


def test_path_stem(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "datasets/adult.csv"), (2, "a/b.tar.gz"), (3, "plain"), (4, "x/.rc")], "id int, p string")
    assert rows(df.select("id", recode.path_stem(F.col("p")).alias("s")), "s") == ["adult", "b.tar", "plain", ".rc"]


def test_require_finite_counts(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "v double")
    with pytest.raises(clean.NonFiniteError, match="3 non-finite"):
        clean.require_finite(df, ["v"], "values")
    clean.require_finite(df.filter("v = 1"), ["v"], "values")


def test_feasibility(spark):
    data = [("a", None), ("b", 1), ("b", 1), ("c", 1), ("c", 2), ("c", None), ("d", 0), ("d", 1), ("d", None)]
    df = spark.createDataFrame(data, "g string, y int")
    out = {r["g"]: r["reason"] for r in clean.target_feasibility(df, ["g"], "y").collect()}
    assert out == {"a": "no labels", "b": "single class", "c": "missing labels", "d": "ok"}


def test_sample_fraction_is_exact(spark):
    df = spark.range(1001)
    assert clean.sample_fraction(df, "id", 0.25).count() == 250
    assert clean.sample_fraction(df, "id", 1.0).count() == 1001
    assert clean.sample_fraction(df, "id", 0.0).count() == 0
