"""Queries for folds, group rules, performance and fairness metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6, state, state_sql
from evenkeel.bindings.views import (
    APPLICANTS,
    GAPPY,
    PREDICTIONS,
    applicants,
    gappy,
    h_sql,
    predictions,
    table,
)
from evenkeel.operators import folds, groups, metrics
from evenkeel.operators.joins import keyed_join

RUN = ["model", "variant"]
FOLD = [*RUN, "fold"]


def _fairness(spark, d):
    return metrics.fairness(predictions(spark, d), FOLD)


def _per_fold(spark, d):
    p = predictions(spark, d)
    return keyed_join(metrics.performance(p, FOLD), metrics.fairness(p, FOLD), FOLD)


# ------------------------------------------------------------------------------ SQL text

FAIR = PREDICTIONS + """, rates as (
  select model, variant, fold, s, count(*) as n, count(*) filter (y = 1) as n_pos,
         count(*) filter (pred = 1) as n_pred_pos, count(*) filter (y = 1 and pred = 1) as n_tp
  from predictions group by model, variant, fold, s),
cells as (select distinct model, variant, fold from predictions),
fair0 as (
  select c.model, c.variant, c.fold,
         u.n_pred_pos / u.n as r0, p.n_pred_pos / p.n as r1,
         u.n_tp / nullif(u.n_pos, 0) as t0, p.n_tp / nullif(p.n_pos, 0) as t1
  from cells c
  left join rates u on u.model = c.model and u.variant = c.variant and u.fold = c.fold and u.s = 0
  left join rates p on p.model = c.model and p.variant = c.variant and p.fold = c.fold and p.s = 1),
fair as (
  select model, variant, fold, abs(r0 - r1) as statistical_parity, abs(t0 - t1) as equal_opportunity,
         case when r1 > 0 then abs(1 - r0 / nullif(r1, 0)) when r1 = 0 and r0 > 0 then 'inf'::double end as disparate_impact
  from fair0)"""

AP = PREDICTIONS + """, score_counts as (
  select model, variant, fold, score, count(*) as n, sum(y) as pos from predictions group by all),
cum as (
  select *, sum(n) over w as cn, sum(pos) over w as cp,
         sum(pos) over (partition by model, variant, fold) as total
  from score_counts window w as (partition by model, variant, fold order by score desc)),
ap as (
  select model, variant, fold, sum(pos / nullif(total, 0) * cp / cn) as average_precision
  from cum group by model, variant, fold)"""

PER_FOLD = FAIR + AP[len(PREDICTIONS):] + """,
plain as (
  select model, variant, fold, min(y) as lo, max(y) as hi,
         avg(case when pred = y then 1.0::double else 0 end) as acc
  from predictions group by model, variant, fold),
per_fold as (
  select f.*, case when p.lo = p.hi then p.acc else a.average_precision end as performance,
         f.statistical_parity + f.equal_opportunity + f.disparate_impact as fold_fairness
  from fair f join plain p using (model, variant, fold) join ap a using (model, variant, fold))"""

COMBINED = """select model, variant, n_folds, n_defined,
  round(case when unbounded or fs is null then null else 0.5 * ps - 0.5 * (fs / 3) end, 6) as fitness,
  case when unbounded then 'unbounded' when fs is null then 'undefined' else 'defined' end as fairness_score_state,
  round(case when not unbounded then fs / 3 end, 6) as fairness_score, round(ps, 6) as performance_score
from (select model, variant, avg(performance) as ps, count(*) as n_folds, count(fold_fairness) as n_defined,
        coalesce(bool_or(isinf(fold_fairness)), false) as unbounded,
        avg(case when not isinf(fold_fairness) then fold_fairness end) as fs
      from per_fold group by model, variant)"""


def fairness_report(spark, d):
    report = metrics.fairness_report(predictions(spark, d), RUN)
    return report.select(
        *RUN,
        "n_folds",
        "n_defined",
        r6("performance_score"),
        F.round(F.when(F.abs("fitness") != float("inf"), F.col("fitness")), 6).alias("fitness"),
        *state("fairness_score"),
    )


def combined_fitness(spark, d):
    """The same scores through the per-fold table, with unequal weights."""
    report = metrics.combined_fitness(_per_fold(spark, d), RUN, 0.7, 0.3)
    return report.select(
        *RUN,
        F.round(F.when(F.abs("fitness") != float("inf"), F.col("fitness")), 6).alias("fitness"),
        (F.col("fitness") == float("-inf")).alias("infeasible"),
    )


def kfold_assign(spark, d):
    rows = folds.kfold(applicants(spark, d), "row_id")
    return rows.select("row_id", "fold")


def stratified_kfold(spark, d):
    return folds.stratified_kfold(applicants(spark, d), "target", "row_id").select("row_id", "target", "fold")


def hash_fold(spark, d):
    o = table(spark, d, "orders")
    return folds.hash_fold(o, "o_orderkey").groupBy("fold").agg(F.count("*").alias("n"))


def pr_auc(spark, d):
    ap = metrics.average_precision(predictions(spark, d), FOLD)
    return ap.select(*FOLD, r6("average_precision"))


def pr_auc_prices(spark, d):
    """Untied scores: every order price is its own threshold."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"),
        F.col("o_totalprice").alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
    )
    return metrics.average_precision(o, ["model"]).select("model", r6("average_precision"))


def accuracy_fallback(spark, d):
    perf = metrics.performance(predictions(spark, d), FOLD)
    return perf.select(*FOLD, "used_accuracy", r6("performance"))


def spd(spark, d):
    return _fairness(spark, d).select(*FOLD, r6("statistical_parity"))


def eod(spark, d):
    return _fairness(spark, d).select(*FOLD, r6("equal_opportunity"))


def disparate_impact(spark, d):
    return _fairness(spark, d).select(*FOLD, *state("disparate_impact"))


def fold_fairness(spark, d):
    f = _fairness(spark, d).withColumn("fold_fairness", metrics.fold_sum())
    return f.select(*FOLD, *state("fold_fairness"))


def group_rates(spark, d):
    return metrics.group_rates(predictions(spark, d), FOLD)


def metric_fold_mean(spark, d):
    means = metrics.metric_fold_means(_fairness(spark, d), RUN)
    return means.select(*RUN, *[c for m in metrics.METRICS for c in state(m)])


def baseline_fairness(spark, d):
    return metrics.baseline_fairness(_fairness(spark, d), RUN).select(
        *RUN, r6("fairness_score"), "undefined_fairness_folds", "fairness_undefined"
    )


def score_minmax(spark, d):
    rows = folds.hash_fold(applicants(spark, d), "row_id")
    scored = metrics.hard_label(metrics.score_minmax(rows, "amount", ["fold"], "row_id"))
    return scored.select("row_id", "fold", r6("score"), "pred")


# --------------------------------------------------------------------------- group rules


def priv_sex(spark, d):
    """Numeric and text columns, with missing values."""
    rows = gappy(spark, d).withColumn("sex_text", F.when(F.col("sex") == 1, "Male").when(F.col("sex") == 0, "F"))
    both = groups.privileged(rows, "sex", ["fold"], "row_id", out="s_number")
    return groups.privileged(both, "sex_text", ["fold"], "row_id", out="s_text").groupBy(
        "s_number", "s_text"
    ).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def priv_race(spark, d):
    rows = applicants(spark, d).select("row_id", (F.col("balance") / 1000).alias("race"))
    return groups.privileged(rows, "race", [], "row_id").select("row_id", "s")


def priv_age(spark, d):
    """Ages above the mean of the row's own fold."""
    rows = folds.hash_fold(applicants(spark, d), "row_id")
    return groups.privileged(rows, "age", ["fold"], "row_id").select("row_id", "fold", "s")


def priv_mode(spark, d):
    """Most frequent segment per fold; a fold where missing values win has nobody."""
    rows = folds.hash_fold(gappy(spark, d), "row_id").withColumn(
        "segment", F.when(F.col("fold") != 3, F.col("segment"))
    )
    return groups.privileged(rows, "segment", ["fold"], "row_id").select("row_id", "fold", "s")


def label_coerce(spark, d):
    """Folds labelled 0/1, 1/2 and 0/1/2."""
    rows = folds.hash_fold(applicants(spark, d), "row_id").withColumn(
        "label",
        F.when(F.col("fold") == 0, F.col("target"))
        .when(F.col("fold") == 1, F.col("target") + 1)
        .otherwise(F.col("target") + F.col("sex")),
    )
    return groups.coerce_labels(rows, "label", ["fold"], "row_id").select("row_id", "fold", "label", "y")


QUERIES = {
    f.__name__: f
    for f in (
        fairness_report, combined_fitness, kfold_assign, stratified_kfold, hash_fold, pr_auc,
        pr_auc_prices, accuracy_fallback, spd, eod, disparate_impact, fold_fairness, group_rates,
        metric_fold_mean, baseline_fairness, score_minmax, priv_sex, priv_race, priv_age,
        priv_mode, label_coerce,
    )
}

_FOLDED = f"folded as (select *, ({h_sql(42, 'row_id')} % 5)::int as fold from "

SQL = {
    "fairness_report": f"with {PER_FOLD} {COMBINED}",
    "combined_fitness": f"""with {PER_FOLD}
select model, variant, round(case when unbounded or fs is null then null else 0.7 * ps - 0.3 * (fs / 3) end, 6) as fitness,
  (unbounded or fs is null) as infeasible
from (select model, variant, avg(performance) as ps, coalesce(bool_or(isinf(fold_fairness)), false) as unbounded,
        avg(case when not isinf(fold_fairness) then fold_fairness end) as fs
      from per_fold group by model, variant)""",
    "kfold_assign": f"""with {APPLICANTS}
select row_id, ((row_number() over (order by {h_sql(42, 'row_id')}, row_id) - 1) % 5)::int as fold from applicants""",
    "stratified_kfold": f"""with {APPLICANTS}
select row_id, target, ((row_number() over (partition by target order by {h_sql(42, 'row_id')}, row_id) - 1) % 5)::int as fold
from applicants""",
    "hash_fold": f"select ({h_sql(42, 'o_orderkey')} % 5)::int as fold, count(*) as n from orders group by 1",
    "pr_auc": f"with {AP} select model, variant, fold, round(average_precision, 6) as average_precision from ap",
    "pr_auc_prices": """with c as (
  select o_orderpriority as model, o_totalprice as score, count(*) as n,
         count(*) filter (o_orderstatus = 'F') as pos from orders group by 1, 2),
cum as (select *, sum(n) over w as cn, sum(pos) over w as cp, sum(pos) over (partition by model) as total
  from c window w as (partition by model order by score desc))
select model, round(sum(pos / total * cp / cn), 6) as average_precision from cum group by model""",
    "accuracy_fallback": f"""with {PER_FOLD}
select f.model, f.variant, f.fold, p.lo = p.hi as used_accuracy, round(f.performance, 6) as performance
from per_fold f join plain p using (model, variant, fold)""",
    "spd": f"with {FAIR} select model, variant, fold, round(statistical_parity, 6) as statistical_parity from fair",
    "eod": f"with {FAIR} select model, variant, fold, round(equal_opportunity, 6) as equal_opportunity from fair",
    "disparate_impact": f"with {FAIR} select model, variant, fold, {state_sql('disparate_impact', 'disparate_impact')} from fair",
    "fold_fairness": f"""with {FAIR}, f as (select *, statistical_parity + equal_opportunity + disparate_impact as ff from fair)
select model, variant, fold, {state_sql('ff', 'fold_fairness')} from f""",
    "group_rates": f"with {FAIR} select * from rates",
    "metric_fold_mean": f"""with {FAIR}, m as (
  select model, variant, avg(statistical_parity) as a, avg(equal_opportunity) as b,
    case when bool_or(isinf(disparate_impact)) then 'inf'::double
         else avg(case when not isinf(disparate_impact) then disparate_impact end) end as c
  from fair group by model, variant)
select model, variant, {state_sql('a', 'statistical_parity')}, {state_sql('b', 'equal_opportunity')},
  {state_sql('c', 'disparate_impact')} from m""",
    "baseline_fairness": f"""with {FAIR}, m as (
  select model, variant, avg(statistical_parity) as a, avg(equal_opportunity) as b,
    case when bool_or(isinf(disparate_impact)) then null
         else avg(case when not isinf(disparate_impact) then disparate_impact end) end as c,
    count(*) filter (statistical_parity is null or equal_opportunity is null or disparate_impact is null
                     or isinf(disparate_impact)) as undefined_fairness_folds
  from fair group by model, variant)
select model, variant, round(coalesce((a + b + c) / 3, 1.0), 6) as fairness_score, undefined_fairness_folds,
  a + b + c is null as fairness_undefined from m""",
    "score_minmax": f"""with {APPLICANTS}, {_FOLDED} applicants),
span as (select fold, min(amount) as lo, max(amount) as hi from folded group by fold),
scored as (select row_id, fold, (amount - lo) / (hi - lo + 1e-12) as v from folded join span using (fold))
select row_id, fold, round(v, 6) as score, case when v >= 0.5 then 1 else 0 end as pred from scored""",
    "priv_sex": f"""with {GAPPY}, g as (select row_id, case when sex = 1 then 1 else 0 end as s_number,
  case when sex = 1 then 1 else 0 end as s_text from gappy)
select s_number, s_text, count(*) as n, sum(row_id)::bigint as ids from g group by all""",
    "priv_race": f"""with {APPLICANTS}
select row_id, case when trunc(balance / 1000) = 1 then 1 else 0 end as s from applicants""",
    "priv_age": f"""with {APPLICANTS}, {_FOLDED} applicants),
m as (select fold, avg(age) as mean_age from folded group by fold)
select row_id, fold, case when age > mean_age then 1 else 0 end as s from folded join m using (fold)""",
    "priv_mode": f"""with {GAPPY}, {_FOLDED} gappy),
f as (select row_id, fold, case when fold <> 3 then segment end as segment from folded),
c as (select fold, segment, count(*) as n, min(row_id) as first from f group by fold, segment),
top as (select fold, segment as top from c qualify row_number() over (partition by fold order by n desc, first) = 1)
select row_id, fold, case when segment = top then 1 else 0 end as s from f join top using (fold)""",
    "label_coerce": f"""with {APPLICANTS}, {_FOLDED} applicants),
f as (select row_id, fold, case fold when 0 then target when 1 then target + 1 else target + sex end as label from folded),
k as (select fold, bool_and(label in (0, 1)) as zo, bool_and(label in (1, 2)) as ot from f group by fold)
select row_id, fold, label, case when zo then label when ot then label - 1 end as y from f join k using (fold)""",
}
