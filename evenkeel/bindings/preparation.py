"""Queries for reading, cleaning, encoding, recoding and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6
from evenkeel.bindings.views import (
    APPLICANTS,
    GAPPY,
    RUNS,
    STATIC,
    applicants,
    gappy,
    h_sql,
    runs,
    static_scores,
    table,
)
from evenkeel.functions import recode
from evenkeel.operators import clean
from evenkeel.operators.analysis import RUN_METRICS
from evenkeel.sources.catalogue import prepare_sample as prepare_sample_op
from evenkeel.sources.tables import load_dataset


def load_scan(spark, d):
    """Three columns and one filter reach the scan."""
    line = load_dataset(spark, f"{d}/lineitem.parquet", columns=["l_returnflag", "l_quantity", "l_discount"])
    return (
        line.filter(F.col("l_quantity") >= 30)
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))
    )


def sample_fraction(spark, d):
    return clean.sample_fraction(applicants(spark, d), "row_id", 0.3).select("row_id", "amount", "segment")


def clean_rows(spark, d):
    kept = clean.drop_unlabelled(gappy(spark, d), "target")
    return kept.select("row_id", "target", "segment")


def clean_cols(spark, d):
    kept = clean.minimal_clean(gappy(spark, d), "target")
    return kept.select(*kept.columns)


def one_hot(spark, d):
    rows = gappy(spark, d).select("row_id", "age", "segment", "priority")
    return clean.one_hot(rows, ["segment", "priority"])


def median_impute(spark, d):
    rows = gappy(spark, d).select("row_id", "amount", "balance", "sex")
    return clean.median_impute(rows, ["amount", "balance", "sex"])


def encode_and_impute(spark, d):
    rows = gappy(spark, d).select("row_id", "amount", "sex", "segment")
    return clean.encode_and_impute(rows, "row_id", "sex")


def prepare_model(spark, d):
    rows = gappy(spark, d).select("row_id", "amount", "balance", "blank", "segment", "sex", "target")
    return clean.prepare_model(rows, "target", "row_id", "sex")


def binarize_values(spark, d):
    rows = gappy(spark, d).select("row_id", "segment")
    return clean.binarize_target(rows, "segment", "row_id", positive=["BUILDING", "MACHINERY"])


def binarize_threshold(spark, d):
    """Numbers kept as text, some of them unreadable."""
    rows = gappy(spark, d).select(
        "row_id",
        F.when(F.col("age") % 7 == 0, "n/a").otherwise(F.col("balance").cast("string")).alias("label"),
    )
    return clean.binarize_target(rows, "label", "row_id", threshold=4000)


def binarize_median(spark, d):
    rows = gappy(spark, d).select("row_id", F.col("balance").alias("label"))
    return clean.binarize_target(rows, "label", "row_id")


def binarize_first_seen(spark, d):
    rows = gappy(spark, d).select("row_id", F.col("target").alias("label"))
    return clean.binarize_target(rows, "label", "row_id", mode="first_seen")


def binarize_sorted(spark, d):
    rows = gappy(spark, d).select(
        "row_id", F.when(F.col("target") == 1, "yes").when(F.col("target") == 0, "no").alias("label")
    )
    return clean.binarize_target(rows, "label", "row_id")


def _income(spark, d):
    p = F.col("priority")
    return gappy(spark, d).select(
        "row_id",
        F.when(p == "1-URGENT", " >50K")
        .when(p == "2-HIGH", ">50K.")
        .when(p == "3-MEDIUM", "<=50K ")
        .when(p == "4-NOT SPECIFIED", "2.5")
        .when(p == "5-LOW", "unknown")
        .alias("salary"),
        F.when(F.col("sex") == 1, "Female").when(F.col("sex") == 0, "Male").alias("sex"),
        F.col("age").cast("string").alias("race"),
    )


def recode_income(spark, d):
    return recode.prepare_income(_income(spark, d))


def recode_codes(spark, d):
    n = F.col("age") % 8
    code = F.concat(F.lit("A9"), F.least(n, F.lit(6)).cast("string"))
    rows = gappy(spark, d).select(
        "row_id",
        F.when(n == 7, "wife").otherwise(code).alias("sex"),
        F.col("age").cast("string").alias("age"),
        (F.col("sex") + F.col("target")).alias("Target"),
    )
    return recode.prepare_credit(rows)


def recode_multiclass(spark, d):
    rows = gappy(spark, d).select(
        "row_id",
        F.col("sex").cast("string").alias("sex"),
        "age",
        F.when(F.col("segment") == "BUILDING", "x").otherwise((F.col("age") % 5).cast("string")).alias("num"),
    )
    return recode.prepare_diagnosis(rows)


def prepare_sample(spark, d):
    """Recode, clean, encode and impute a raw table; the label is left as it is."""
    rows = gappy(spark, d).select(
        "row_id", "amount", "segment", "sex", "age", (F.col("target") * 3).alias("num"), "blank"
    )
    return prepare_sample_op(rows, "diagnosis", "num", "sex", "row_id")


def non_finite_report(spark, d):
    r = gappy(spark, d).select(
        "amount",
        "balance",
        F.when(F.col("age") == 20, float("nan")).when(F.col("age") == 21, float("inf")).otherwise(1.0).alias("ratio"),
    )
    return clean.non_finite_report(r, ["amount", "balance", "ratio"])


def path_stem(spark, d):
    r = runs(spark, d).select("ord", "dataset")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("dataset"))
    return r.unionByName(pages).select("ord", "dataset", recode.path_stem(F.col("dataset")).alias("stem"))


def metric_clean(spark, d):
    """Text metrics to finite numbers, and how many rows lack at least one."""
    r = runs(spark, d).select("dataset", *[F.col(c).cast("string").alias(c) for c in RUN_METRICS])
    r = r.withColumn("performance_score", F.coalesce("performance_score", F.lit("failed")))
    cleaned = clean.clean_metrics(r, list(RUN_METRICS))
    lacking = F.lit(False)
    for c in RUN_METRICS:
        lacking = lacking | F.col(c).isNull()
    return cleaned.groupBy("dataset").agg(
        F.count("*").alias("n_rows"),
        F.count_if(lacking).alias("n_dropped"),
        *[F.count(c).alias(f"n_{c}") for c in RUN_METRICS],
    )


def target_feasibility(spark, d):
    rows = gappy(spark, d).withColumn(
        "label",
        F.when(F.col("age") < 20, F.lit(None))
        .when(F.col("age") < 30, 1)
        .when(F.col("age") < 40, F.col("target") + 1)
        .otherwise(F.col("target")),
    )
    return clean.target_feasibility(rows, ["age"], "label")


def unpivot_methods(spark, d):
    wide = runs(spark, d).select("ord", "fitness", "fairness_score", "performance_score")
    wide = wide.withColumn("fitness", F.when(F.abs("fitness") != float("inf"), F.col("fitness")))
    names = {"fitness": "Best", "fairness_score": "All practices", "performance_score": "No practices"}
    return clean.unpivot_methods(wide, ["ord"], names, "score").select("ord", "method", r6("score"))


def pivot_mean(spark, d):
    keys = ["dataset", "protected_attribute"]
    wide = clean.pivot_mean(static_scores(spark, d), keys, "baseline", ["all", "none"], ["fitness", "fairness"])
    return wide.select(*keys, *[r6(c) for c in wide.columns if c not in keys])


QUERIES = {
    f.__name__: f
    for f in (
        load_scan, sample_fraction, clean_rows, clean_cols, one_hot, median_impute,
        encode_and_impute, prepare_model, binarize_values, binarize_threshold, binarize_median,
        binarize_first_seen, binarize_sorted, recode_income, recode_codes, recode_multiclass,
        prepare_sample, non_finite_report, path_stem, metric_clean, target_feasibility,
        unpivot_methods, pivot_mean,
    )
}

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummies(col: str, values: list[str]) -> str:
    return ", ".join(f"coalesce({col} = '{v}', false) as \"{col}_{v}\"" for v in values[1:])


def _filled(col: str, table: str = "gappy") -> str:
    return f"coalesce({col}::double, (select quantile_cont({col}::double, 0.5) from {table})) as {col}"


_STEM = r"regexp_replace(regexp_extract({0}, '[^/]*$'), '([^.])\.[^.]*$', '\1')"
_FINITE = "case when isfinite({0}) then {0} end"

SQL = {
    "load_scan": """select l_returnflag, count(*) as n, round(avg(l_discount), 6) as mean_discount
from lineitem where l_quantity >= 30 group by 1""",
    "sample_fraction": f"""with {APPLICANTS}
select row_id, amount, segment from applicants
qualify row_number() over (order by {h_sql(42, 'row_id')}, row_id) <= round_even(0.3::double * count(*) over (), 0)""",
    "clean_rows": f"with {GAPPY} select row_id, target, segment from gappy where target is not null",
    "clean_cols": f"""with {GAPPY}
select row_id, amount, balance, segment, priority, age, sex, target from gappy where target is not null""",
    "one_hot": f"""with {GAPPY} select row_id, age, {_dummies('segment', _SEGMENTS)}, {_dummies('priority', _PRIORITIES)} from gappy""",
    "median_impute": f"with {GAPPY} select row_id, {_filled('amount')}, {_filled('balance')}, {_filled('sex')} from gappy",
    "encode_and_impute": f"with {GAPPY} select row_id, {_filled('amount')}, {_dummies('segment', _SEGMENTS)}, sex from gappy",
    "prepare_model": f"""with {GAPPY}, kept as (select * from gappy where target is not null)
select row_id, {_filled('amount', 'kept')}, {_filled('balance', 'kept')}, {_dummies('segment', _SEGMENTS)},
  target::double as target, sex from kept""",
    "binarize_values": f"with {GAPPY} select row_id, coalesce(segment in ('BUILDING', 'MACHINERY'), false)::int as segment from gappy",
    "binarize_threshold": f"""with {GAPPY}
select row_id, coalesce(case when age % 7 <> 0 then balance end >= 4000, false)::int as label from gappy""",
    "binarize_median": f"""with {GAPPY}
select row_id, coalesce(balance >= (select quantile_cont(balance, 0.5) from gappy), false)::int as label from gappy""",
    "binarize_first_seen": f"""with {GAPPY}, f as (select target as first from gappy where target is not null order by row_id limit 1)
select row_id, case when target is not null then (target <> first)::int end as label from gappy, f""",
    "binarize_sorted": f"with {GAPPY} select row_id, target::int as label from gappy",
    "recode_income": f"""with {GAPPY}
select row_id, case priority when '1-URGENT' then 1.0::double when '2-HIGH' then 1.0 when '3-MEDIUM' then 0.0 when '4-NOT SPECIFIED' then 2.5 end as salary,
  case when sex = 1 then 1.0::double else 0 end as sex, age::double as race from gappy""",
    "recode_codes": f"""with {GAPPY}
select row_id, case when age % 8 in (2, 5, 7) then 1 else 0 end as sex, age::double as age,
  (case sex + target when 2 then 1 when 1 then 0 else sex + target end)::double as "Target" from gappy""",
    "recode_multiclass": f"""with {GAPPY}
select row_id, sex::double as sex, age::double as age,
  case when segment = 'BUILDING' then 0 when age % 5 > 0 then 1 else 0 end as num from gappy""",
    "prepare_sample": f"""with {GAPPY}, kept as (select row_id, amount, segment, sex, age, target from gappy)
select row_id, {_filled('amount', 'kept')}, age::double as age, coalesce(target * 3 > 0, false)::int::double as num,
  {_dummies('segment', _SEGMENTS)}, sex::double as sex from kept""",
    "non_finite_report": f"""with {GAPPY}
select 'amount' as column_name, count(*) filter (amount is null) as n_bad from gappy union all
select 'balance', count(*) filter (balance is null) from gappy union all
select 'ratio', count(*) filter (age in (20, 21)) from gappy""",
    "path_stem": f"""with {RUNS}, p as (select ord, dataset from runs union all select page_id, url from pages)
select ord, dataset, {_STEM.format('dataset')} as stem from p""",
    "metric_clean": f"""with {RUNS}, c as (select dataset, {_FINITE.format('fitness')} as f, fairness_score as s,
  performance_score as p, elapsed_seconds as e from runs)
select dataset, count(*) as n_rows, count(*) filter (f is null or s is null or p is null or e is null) as n_dropped,
  count(f) as n_fitness, count(s) as n_fairness_score, count(p) as n_performance_score, count(e) as n_elapsed_seconds
from c group by dataset""",
    "target_feasibility": f"""with {GAPPY}, l as (select age, case when age < 20 then null when age < 30 then 1
  when age < 40 then target + 1 else target end as label from gappy),
c as (select age, count(*) as n_rows, count(label) as n_labels, count(distinct label) as n_classes, min(label) as lo, max(label) as hi from l group by age),
r as (select *, case when n_labels = 0 then 'no labels' when n_classes = 1 then 'single class'
  when n_classes = 2 and not (lo = 0 and hi = 1) and n_labels < n_rows then 'missing labels' else 'ok' end as reason from c)
select age, n_rows, n_labels, n_classes, reason = 'ok' as feasible, reason from r""",
    "unpivot_methods": f"""with {RUNS}
select ord, 'Best' as method, round({_FINITE.format('fitness')}, 6) as score from runs union all
select ord, 'All practices', round(fairness_score, 6) from runs union all
select ord, 'No practices', round(performance_score, 6) from runs""",
    "pivot_mean": f"""with {STATIC}
select dataset, protected_attribute,
  round(avg(fitness) filter (baseline = 'all'), 6) as fitness_all, round(avg(fitness) filter (baseline = 'none'), 6) as fitness_none,
  round(avg(fairness) filter (baseline = 'all'), 6) as fairness_all, round(avg(fairness) filter (baseline = 'none'), 6) as fairness_none
from static_scores group by all""",
}
