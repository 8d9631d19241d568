"""Queries for the mitigation methods."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6
from evenkeel.bindings.views import APPLICANT, APPLICANTS, applicants, h60_sql, h_sql, table
from evenkeel.operators import mitigation


def quadrant_oversample(spark, d):
    rows = applicants(spark, d).select("row_id", "amount", "target", "sex")
    return mitigation.quadrant_oversample(rows, "target", "sex", "row_id")


def binarize_mode(spark, d):
    """Majority segment, and ages above the mean."""
    rows = applicants(spark, d).select("row_id", "segment", "age")
    one = mitigation.binarize_group(rows, "segment", "s_segment")
    return mitigation.binarize_group(one, "age", "s_age")


def reweigh(spark, d):
    rows = applicants(spark, d).select("row_id", "target", "sex")
    done = mitigation.reweigh(rows, "target", "sex", "row_id")
    return done.select("row_id", "target", "sex", r6("weight"))


def reweigh_values(spark, d):
    """A many-valued group column: only the values 0 and 1 take part."""
    rows = applicants(spark, d).select("row_id", "target", "nation")
    done = mitigation.reweigh(rows, "target", "nation", "row_id")
    return done.select("row_id", "nation", r6("weight"))


def repair_feature(spark, d):
    rows = applicants(spark, d).select("row_id", "balance", "segment", "target")
    done = mitigation.repair_features(rows, APPLICANT.with_(protected="segment"), ["balance"])
    return done.select("row_id", "segment", r6("balance"))


def repair_ties(spark, d):
    """A feature with few distinct values over all order lines."""
    line = table(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        "l_quantity",
        "l_returnflag",
    )
    roles = APPLICANT.with_(protected="l_returnflag")
    return mitigation.repair_features(line, roles, ["l_quantity"]).groupBy("l_returnflag", "l_quantity").agg(
        F.count("*").alias("n")
    )


def repair_all(spark, d):
    """All numeric features at once, between two groups."""
    rows = applicants(spark, d).select("row_id", "amount", "balance", "age", "sex", "target")
    done = mitigation.repair_features(rows, APPLICANT)
    return done.select("row_id", r6("amount"), r6("balance"), r6("age"), "sex", "target")


QUERIES = {
    f.__name__: f
    for f in (quadrant_oversample, binarize_mode, reweigh, reweigh_values, repair_feature, repair_ties, repair_all)
}


def _repair_sql(source: str, g: str, v: str, n: str = "") -> str:
    """Repaired values of ``v`` per (group, value), by the grid of the smallest group."""
    text = f"""cnt as (select {g} as g, {v}::double as v, count(*) as n from {source} group by all),
placed as (select *, coalesce(sum(n) over (partition by g order by v rows between unbounded preceding and 1 preceding), 0)::bigint as before,
  (sum(n) over (partition by g))::bigint as size from cnt),
steps as (select min(size) as b from placed),
grid as (select g, size, q, (q * size) // b as pos from (select distinct g, size from placed), steps, lateral (select unnest(range(0, b)) as q)),
target as (select q, quantile_cont(v, 0.5) as v_new from grid join placed p using (g)
  where pos >= p.before and pos < p.before + p.n group by q),
mapping as (select g, v, v_new from placed, steps join target on q = (before * b) // size)"""
    for name in ("cnt", "placed", "steps", "grid", "target", "mapping") if n else ():
        text = re.sub(rf"\b{name}\b", f"{name}{n}", text)
    return text


SQL = {
    "quadrant_oversample": f"""with {APPLICANTS},
q as (select *, target || ':' || sex as cell from applicants),
sizes as (select target, sex, count(*) as n, max(count(*)) over () as m from applicants group by target, sex),
d as (select target, sex, n, unnest(range(0, m - n)) as i from sizes),
r as (select *, row_number() over (partition by target, sex order by {h_sql('42:rank', 'row_id')}, row_id) as rank_ from applicants)
select row_id::varchar as row_id, amount, target, sex from applicants union all
select r.row_id || '#' || i, amount, r.target, r.sex from d join r
  on r.target = d.target and r.sex = d.sex and rank_ = 1 + {h60_sql(42, 'd.target', 'd.sex', 'd.i')} % n""",
    "binarize_mode": f"""with {APPLICANTS}, top as (select segment as t from applicants group by segment order by count(*) desc, segment limit 1)
select row_id, segment, age, (segment = t)::int as s_segment, (age > avg(age) over ())::int as s_age from applicants, top""",
    "reweigh": f"""with {APPLICANTS}
select row_id, target, sex, round((count(*) over (partition by sex))::double * count(*) over (partition by target)
  / ((count(*) over ())::double * count(*) over (partition by sex, target)), 6) as weight from applicants""",
    "reweigh_values": f"""with {APPLICANTS}, c as (select nation, target, count(*) as n from applicants where nation in (0, 1) group by all),
w as (select nation, target, (sum(n) over (partition by nation))::double * sum(n) over (partition by target)
  / (n::double * (select count(*) from applicants)) as w from c)
select row_id, a.nation, round(coalesce(w, 1.0), 6) as weight from applicants a left join w on w.nation = a.nation and w.target = a.target""",
    "repair_feature": f"""with {APPLICANTS}, {_repair_sql('applicants', 'segment', 'balance')}
select row_id, segment, round(v_new, 6) as balance from applicants join mapping on g = segment and v = balance""",
    "repair_ties": f"""with {_repair_sql('lineitem', 'l_returnflag', 'l_quantity')}
select l_returnflag, v_new as l_quantity, count(*) as n from lineitem join mapping on g = l_returnflag and v = l_quantity group by all""",
    "repair_all": f"""with {APPLICANTS}, {_repair_sql('applicants', 'sex', 'amount', '1')}, {_repair_sql('applicants', 'sex', 'balance', '2')},
{_repair_sql('applicants', 'sex', 'age', '3')}
select row_id, round(a.v_new, 6) as amount, round(b.v_new, 6) as balance, round(c.v_new, 6) as age, sex, target
from applicants join mapping1 a on a.g = sex and a.v = amount join mapping2 b on b.g = sex and b.v = balance
join mapping3 c on c.g = sex and c.v = age""",
}
