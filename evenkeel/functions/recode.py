"""Row-level recoding of labels, codes, protected values and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def to_number(col: Column) -> Column:
    """Double, or NULL for anything unparsable (and for NaN)."""
    parsed = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def equals_one(col: Column) -> Column:
    """1 where the number, cut to its integer part, is 1; NULL and text count as 0."""
    number = F.coalesce(to_number(col), F.lit(0.0))
    return F.when((number >= 1) & (number < 2), F.lit(1)).otherwise(F.lit(0))


def privileged_sex(df: DataFrame, name: str) -> Column:
    """Numeric 1, or the texts 'male' / 'm' in any case."""
    if is_text(df, name):
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        return F.when(low.isin("male", "m"), F.lit(1)).otherwise(F.lit(0))
    return equals_one(F.col(name))


def income_label(df: DataFrame, name: str) -> Column:
    """Income brackets to 1/0; other text is read as a number."""
    if not is_text(df, name):
        return to_number(F.col(name))
    text = F.trim(F.col(name))
    # The bracket spellings of the census file.
    return (
        F.when(text.isin(">50K", ">50K."), F.lit(1.0))
        .when(text.isin("<=50K", "<=50K."), F.lit(0.0))
        .otherwise(to_number(text))
    )


def female_flag(df: DataFrame, name: str) -> Column:
    """Text containing 'female' to 1, other text (and NULL text) to 0; numbers pass through."""
    if is_text(df, name):
        hit = F.lower(F.coalesce(F.col(name), F.lit(""))).contains("female")
        return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
    return to_number(F.col(name))


def status_sex(col: Column) -> Column:
    """Personal-status code to 1 (female) / 0."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    # Codes of the credit file.
    return (
        F.when(text.contains("A95") | text.contains("A92"), F.lit(1))
        .when(text.contains("A93") | text.contains("A91") | text.contains("A94"), F.lit(0))
        .when(F.lower(text).contains("f"), F.lit(1))
        .otherwise(F.lit(0))
    )


def two_class_target(col: Column) -> Column:
    """2 to 1, 1 to 0, any other number unchanged."""
    number = to_number(col)
    return F.when(number == 2, F.lit(1.0)).when(number == 1, F.lit(0.0)).otherwise(number)


def severity_target(col: Column) -> Column:
    """Positive numbers to 1; zero, NULL and text to 0."""
    return F.when(to_number(col) > 0, F.lit(1)).otherwise(F.lit(0))


def path_stem(col: Column) -> Column:
    """Base name of a path without its last extension ('.profile' keeps its name)."""
    base = F.regexp_extract(col, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def prepare_income(df: DataFrame) -> DataFrame:
    """Recode ``salary``, ``sex`` (or its two dummy columns) and ``race``."""
    new = {}
    if "salary" in df.columns:
        new["salary"] = income_label(df, "salary")
    if {"sex_Female", "sex_Male"} <= set(df.columns):
        new["sex"] = F.coalesce(F.col("sex_Female").cast("double"), F.lit(0.0)).cast("int")
    elif "sex" in df.columns:
        new["sex"] = female_flag(df, "sex")
    if "race" in df.columns:
        new["race"] = to_number(F.col("race"))
    return df.withColumns(new) if new else df


def prepare_credit(df: DataFrame) -> DataFrame:
    """Recode ``sex`` codes, ``Age``/``age`` and the two-class ``Target``."""
    new = {}
    if "sex" in df.columns:
        new["sex"] = status_sex(F.col("sex"))
    for name in ("Age", "age"):
        if name in df.columns:
            new[name] = to_number(F.col(name))
    if "Target" in df.columns:
        new["Target"] = two_class_target(F.col("Target"))
    return df.withColumns(new) if new else df


def prepare_diagnosis(df: DataFrame) -> DataFrame:
    """Make ``sex`` and ``age`` numeric and reduce ``num`` to absent / present."""
    new = {name: to_number(F.col(name)) for name in ("sex", "age") if name in df.columns}
    if "num" in df.columns:
        new["num"] = severity_target(F.col("num"))
    return df.withColumns(new) if new else df


PREPARERS = {
    "income": prepare_income,
    "credit": prepare_credit,
    "diagnosis": prepare_diagnosis,
}
