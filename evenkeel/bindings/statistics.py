"""Queries for the paired comparisons of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6
from evenkeel.bindings.views import (
    DIRECTIONS,
    METHOD_ROWS,
    PAIR_KEYS,
    TREATMENT,
    h60_sql,
    h_sql,
    methods,
    table,
)
from evenkeel.operators import stats
from evenkeel.operators.stats import HYPOTHESIS


def every_baseline(spark, d):
    """Every order priority but the treatment."""
    found = table(spark, d, "orders").select("o_orderpriority").distinct().collect()  # a priority each
    return sorted(r[0] for r in found if r[0] not in (None, TREATMENT))


def _pairs(spark, d):
    return stats.paired_values(
        methods(spark, d), PAIR_KEYS, "method", TREATMENT, every_baseline(spark, d), list(DIRECTIONS)
    )


def _event_pairs(spark, d):
    """Users' mean event values, clicks against every other event type."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 3).alias("value"))
    others = sorted(r[0] for r in e.select("event_type").distinct().collect() if r[0] != "click")
    return stats.paired_values(e, ["user_id"], "event_type", "click", others, ["value"])


def _diffs(pairs, *keys):
    return pairs.select(*HYPOTHESIS, F.concat_ws("|", *keys).alias("pair"), (F.col("x") - F.col("y")).alias("d"))


def paired_values(spark, d):
    return _pairs(spark, d).select(*HYPOTHESIS, "dataset_name", r6("x", 9), r6("y", 9))


def paired_values_events(spark, d):
    return _event_pairs(spark, d).select(*HYPOTHESIS, "user_id", r6("x", 3), r6("y", 3))


def a12(spark, d):
    return stats.a12(_pairs(spark, d), HYPOTHESIS).select(*HYPOTHESIS, r6("a12_raw"))


def a12_events(spark, d):
    return stats.a12(_event_pairs(spark, d), HYPOTHESIS).select(*HYPOTHESIS, r6("a12_raw"))


def wilcoxon_stat(spark, d):
    """Signed-rank sums with ties, over all users."""
    r = stats.signed_ranks(_event_pairs(spark, d), HYPOTHESIS)
    return r.select(*HYPOTHESIS, "n_used", r6("w_plus", 1), r6("w_minus", 1), r6("tie_term", 1))


def wilcoxon_p(spark, d):
    """Exact distribution: 25 pairs per hypothesis."""
    t = stats.signed_rank_test(_pairs(spark, d), HYPOTHESIS)
    return t.select(*HYPOTHESIS, "n_used", r6("p_value", 9))


def wilcoxon_p_normal(spark, d):
    """Normal approximation with tie correction: many pairs."""
    t = stats.signed_rank_test(_event_pairs(spark, d), HYPOTHESIS)
    return t.select(*HYPOTHESIS, "n_used", r6("p_value"))


def mgg_symmetry(spark, d):
    diffs = _diffs(_pairs(spark, d), *PAIR_KEYS)
    s = stats.symmetry_statistic(stats.difference_counts(diffs, HYPOTHESIS), HYPOTHESIS)
    return s.select(*HYPOTHESIS, "n", r6("symmetry_stat"))


def mgg_symmetry_events(spark, d):
    diffs = _diffs(_event_pairs(spark, d), "user_id")
    s = stats.symmetry_statistic(stats.difference_counts(diffs, HYPOTHESIS), HYPOTHESIS)
    return s.select(*HYPOTHESIS, "n", r6("symmetry_stat"))


def symmetry_bootstrap(spark, d):
    """Ten thousand replicates per hypothesis."""
    t = stats.symmetry_test(_diffs(_pairs(spark, d), *PAIR_KEYS), HYPOTHESIS, "pair", replicates=10_000)
    return t.select(*HYPOTHESIS, r6("symmetry_stat"), "n_beyond", r6("symmetry_p"))


def sign_test(spark, d):
    t = stats.sign_test(_pairs(spark, d), HYPOTHESIS)
    return t.select(*HYPOTHESIS, "n_up", "n_used", r6("sign_p", 9))


def sign_test_events(spark, d):
    t = stats.sign_test(_event_pairs(spark, d), HYPOTHESIS)
    return t.select(*HYPOTHESIS, "n_up", "n_used", r6("sign_p"))


def holm_adjust(spark, d):
    """One p-value per part and brand family, with ties."""
    p = table(spark, d, "part").select(
        "p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(200000.0)).alias("p")
    )
    return stats.holm_adjust(p, ["p_brand"], "p", F.col("p_partkey"), "p_holm").select(
        "p_partkey", "p_brand", r6("p_holm", 9)
    )


def _compared(spark, d):
    return stats.compare_methods(
        methods(spark, d), PAIR_KEYS, "method", TREATMENT, every_baseline(spark, d), DIRECTIONS, replicates=10_000
    )


def compare_methods(spark, d):
    c = _compared(spark, d)
    numbers = ["treatment_mean", "baseline_mean", "p_value", "a12_raw", "a12_effective", "symmetry_stat", "symmetry_p", "sign_p"]
    return c.select(*HYPOTHESIS, "direction", "n_pairs", *[r6(n) for n in numbers])


def hypothesis_table(spark, d):
    t = stats.hypothesis_table(_compared(spark, d))
    return t.select(
        *HYPOTHESIS, "n_pairs", r6("p_holm"), r6("sign_p_holm"), "symmetric", "significant",
        "sign_significant", "who_is_better", "conclusion_robust",
    )


QUERIES = {
    f.__name__: f
    for f in (
        paired_values, paired_values_events, a12, a12_events, wilcoxon_stat, wilcoxon_p,
        wilcoxon_p_normal, mgg_symmetry, mgg_symmetry_events, symmetry_bootstrap, sign_test,
        sign_test_events, holm_adjust, compare_methods, hypothesis_table,
    )
}


#: Queries that took three of four baselines before; their old names for the whole job stay registered.
PAIRED = [paired_values, a12, wilcoxon_p, mgg_symmetry, symmetry_bootstrap, sign_test, compare_methods, hypothesis_table]
QUERIES |= {f"{f.__name__}_all": f for f in PAIRED}

EVENTS = """means as (select user_id, event_type, round(avg(value), 3) as v from events group by all),
pairs as (select 'value' as metric, b.event_type as baseline, user_id, t.v as x, b.v as y, t.v - b.v as d
  from means b join means t using (user_id) where t.event_type = 'click' and b.event_type <> 'click')"""

_A12 = """l as (select metric, baseline, x as v, 1 as side from pairs union all select metric, baseline, y, 0 from pairs),
r as (select *, rank() over (partition by metric, baseline order by v)
  + (count(*) over (partition by metric, baseline, v) - 1) / 2.0::double as rk from l),
a as (select metric, baseline, (sum(rk) filter (side = 1) / count(*) filter (side = 1)
  - (count(*) filter (side = 1) + 1) / 2.0::double) / count(*) filter (side = 0) as a12_raw from r group by all)"""

_RANKS = """nz as (select metric, baseline, d, abs(d) as v from pairs where d <> 0),
sr as (select *, rank() over (partition by metric, baseline order by v)
  + (count(*) over (partition by metric, baseline, v) - 1) / 2.0::double as rk,
  count(*) over (partition by metric, baseline, v) as tie from nz),
w as (select metric, baseline, count(*) as n_used, coalesce(sum(rk) filter (d > 0), 0) as w_plus,
  coalesce(sum(rk) filter (d < 0), 0) as w_minus, sum(tie::double * tie - 1) as tie_term from sr group by all)"""

# subset sums of 1..n by repeated list addition, for every n up to 50
_EXACT = """ways as (
  with recursive dp(n, c) as (
    select 0, [1.0::double] union all
    select n + 1, list_transform(range(0, len(c) + n + 1), lambda i: coalesce(c[i + 1], 0) + coalesce(case when i >= n + 1 then c[i - n] end, 0))
    from dp where n < 50)
  select n, c from dp),
wp as (select metric, baseline, n_used, least(1.0, 2 * list_sum(c[1:(least(w_plus, w_minus)::bigint + 1)]) / pow(2.0, n_used)) as p_value
  from w join ways on ways.n = n_used)"""

# upper tail of the normal distribution by Simpson's rule on [|z|, |z| + 12]
_NORMAL = """zs as (select *, abs((w_plus - n_used * (n_used + 1) / 4.0::double)
  / sqrt((n_used::double * (n_used + 1) * (2 * n_used + 1) - tie_term / 2) / 24)) as z from w),
wn as (select metric, baseline, any_value(n_used) as n_used,
  2 * sum((case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(z + i * 0.003, 2) / 2)) * 0.003 / 3 / sqrt(2 * pi()) as p_value
  from zs, (select unnest(range(0, 4001)) as i) group by metric, baseline)"""

_MGG = """med as (select metric, baseline, count(*) as n, avg(d) as mean, quantile_cont(d, 0.5) as median from pairs group by all),
spread as (select metric, baseline, avg(abs(d - median)) as j from pairs join med using (metric, baseline) group by all),
obs as (select metric, baseline, n, median, case when j = 0 then 0.0 else sqrt(n) * (mean - median) / (sqrt(pi() / 2) * j) end as symmetry_stat
  from med join spread using (metric, baseline))"""


def _bootstrap(replicates: int) -> str:
    key = "(dataset_name || '|' || protected_attribute || '|' || model_identifier)"
    return f"""pool as (
  select metric, baseline, row_number() over (partition by metric, baseline order by {h_sql(20260930, key)}, {key}) - 1 as rk, d - median as c, n
  from pairs join obs using (metric, baseline)),
draws as (
  select metric, baseline, n, rep, pos, {h60_sql(20260930, 'metric', 'baseline', 'rep', 'pos')} % (2 * n) as idx
  from obs, (select unnest(range(0, {replicates})) as rep), lateral (select unnest(range(0, n)) as pos)),
sampled as (
  select w.metric, w.baseline, rep, case when idx < w.n then c else -c end as d
  from draws w join pool p on p.metric = w.metric and p.baseline = w.baseline and p.rk = idx % w.n),
rm as (select metric, baseline, rep, count(*) as n, avg(d) as mean, quantile_cont(d, 0.5) as median from sampled group by all),
rj as (select metric, baseline, rep, avg(abs(d - median)) as j from sampled join rm using (metric, baseline, rep) group by all),
null_t as (select metric, baseline, case when j = 0 then 0.0 else sqrt(n) * (mean - median) / (sqrt(pi() / 2) * j) end as t
  from rm join rj using (metric, baseline, rep)),
boot as (select metric, baseline, any_value(symmetry_stat) as symmetry_stat, count(*) filter (abs(t) >= abs(symmetry_stat)) as n_beyond
  from null_t join obs using (metric, baseline) group by all),
bootp as (select *, (n_beyond + 1) / {replicates + 1} as symmetry_p from boot)"""


_SIGN = """sc as (select metric, baseline, count(*) filter (d > 0) as n_up, count(*) filter (d <> 0) as n_used from pairs group by all),
terms as (select metric, baseline, n_up, n_used, k, lgamma(n_used + 1) - lgamma(k + 1) - lgamma(n_used - k + 1) - n_used * ln(2.0) as lt
  from sc, lateral (select unnest(range(0, least(n_up, n_used - n_up) + 1)) as k)),
sg as (select metric, baseline, n_up, n_used, least(1.0, 2 * sum(exp(lt))) as sign_p from terms group by all)"""


_COMPARED = f"""{_A12}, {_RANKS}, {_EXACT}, {_MGG}, {_bootstrap(10_000)}, {_SIGN},
basics as (select metric, baseline, count(*) as n_pairs, avg(x) as treatment_mean, avg(y) as baseline_mean from pairs group by all),
compared as (select *, case when metric = 'performance_score' then 'higher' else 'lower' end as direction,
    case when metric = 'performance_score' then a12_raw else 1.0 - a12_raw end as a12_effective
  from basics join a using (metric, baseline) join (select metric, baseline, p_value from wp) using (metric, baseline)
  join bootp using (metric, baseline) join (select metric, baseline, sign_p from sg) using (metric, baseline))"""

SQL = {
    "paired_values": f"with {METHOD_ROWS} select metric, baseline, dataset_name, round(x, 9) as x, round(y, 9) as y from pairs",
    "paired_values_events": f"with {EVENTS} select metric, baseline, user_id, round(x, 3) as x, round(y, 3) as y from pairs",
    "a12": f"with {METHOD_ROWS}, {_A12} select metric, baseline, round(a12_raw, 6) as a12_raw from a",
    "a12_events": f"with {EVENTS}, {_A12} select metric, baseline, round(a12_raw, 6) as a12_raw from a",
    "wilcoxon_stat": f"""with {EVENTS}, {_RANKS} select metric, baseline, n_used, round(w_plus, 1) as w_plus, round(w_minus, 1) as w_minus,
  round(tie_term, 1) as tie_term from w""",
    "wilcoxon_p": f"with {METHOD_ROWS}, {_RANKS}, {_EXACT} select metric, baseline, n_used, round(p_value, 9) as p_value from wp",
    "wilcoxon_p_normal": f"with {EVENTS}, {_RANKS}, {_NORMAL} select metric, baseline, n_used, round(p_value, 6) as p_value from wn",
    "mgg_symmetry": f"with {METHOD_ROWS}, {_MGG} select metric, baseline, n, round(symmetry_stat, 6) as symmetry_stat from obs",
    "mgg_symmetry_events": f"with {EVENTS}, {_MGG} select metric, baseline, n, round(symmetry_stat, 6) as symmetry_stat from obs",
    "symmetry_bootstrap": f"""with {METHOD_ROWS}, {_MGG}, {_bootstrap(10_000)}
select metric, baseline, round(symmetry_stat, 6) as symmetry_stat, n_beyond, round(symmetry_p, 6) as symmetry_p from bootp""",
    "sign_test": f"with {METHOD_ROWS}, {_SIGN} select metric, baseline, n_up, n_used, round(sign_p, 9) as sign_p from sg",
    "sign_test_events": f"with {EVENTS}, {_SIGN} select metric, baseline, n_up, n_used, round(sign_p, 6) as sign_p from sg",
    "holm_adjust": """with p as (select p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 200000.0::double as p from part),
r as (select *, (count(*) over (partition by p_brand) - row_number() over (partition by p_brand order by p, p_partkey) + 1) * p as raw from p)
select p_partkey, p_brand, round(least(1.0, max(raw) over (partition by p_brand order by p, p_partkey rows unbounded preceding)), 9) as p_holm from r""",
    "compare_methods": f"""with {METHOD_ROWS}, {_COMPARED} select metric, baseline, direction, n_pairs, round(treatment_mean, 6) as treatment_mean,
  round(baseline_mean, 6) as baseline_mean, round(p_value, 6) as p_value, round(a12_raw, 6) as a12_raw, round(a12_effective, 6) as a12_effective,
  round(symmetry_stat, 6) as symmetry_stat, round(symmetry_p, 6) as symmetry_p, round(sign_p, 6) as sign_p from compared""",
    "hypothesis_table": f"""with {METHOD_ROWS}, {_COMPARED}, h1 as (
  select *, (count(*) over () - row_number() over (order by p_value, metric, baseline) + 1) * p_value as m_p,
    (count(*) over () - row_number() over (order by sign_p, metric, baseline) + 1) * sign_p as m_s from compared),
h as (select *, least(1.0, max(m_p) over (order by p_value, metric, baseline rows unbounded preceding)) as p_holm,
    least(1.0, max(m_s) over (order by sign_p, metric, baseline rows unbounded preceding)) as sign_p_holm from h1)
select metric, baseline, n_pairs, round(p_holm, 6) as p_holm, round(sign_p_holm, 6) as sign_p_holm, symmetry_p >= 0.05 as symmetric,
  p_holm < 0.05 as significant, sign_p_holm < 0.05 as sign_significant,
  case when p_holm >= 0.05 then 'No_diff' when a12_effective > 0.5 then 'Treatment_better'
       when a12_effective < 0.5 then 'Baseline_better' else 'Tie' end as who_is_better,
  (p_holm < 0.05) = (sign_p_holm < 0.05) as conclusion_robust from h""",
}

SQL |= {f"{f.__name__}_all": SQL[f.__name__] for f in PAIRED}
