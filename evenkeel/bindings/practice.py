"""Queries for the eight practices and their chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.bindings.check import r6
from evenkeel.bindings.views import (
    APPLICANT,
    APPLICANTS,
    GAPPY,
    applicants,
    gappy,
    h60_sql,
    h_sql,
    table,
)
from evenkeel.operators import practices
from evenkeel.roles import TECHNIQUES, Roles

NUMBERS = ["amount", "balance", "nation", "age", "target"]
NATION = APPLICANT.with_(protected="nation")


def _rows(spark, d):
    return applicants(spark, d).select("row_id", "amount", "balance", "nation", "age", "segment", "sex", "target")


def _rounded(df, *cols):
    return df.select(*[r6(c) if c in cols else F.col(c) for c in df.columns])


def scale_standard(spark, d):
    return _rounded(practices.standard(_rows(spark, d), APPLICANT), *NUMBERS)


def scale_standard_gaps(spark, d):
    """Missing values stay missing, a constant column becomes 0, the label is left alone."""
    rows = gappy(spark, d).select("row_id", "amount", "balance", F.lit(3).alias("fixed"), "sex", "target")
    return _rounded(
        practices.standard(rows, APPLICANT, exclude=("target",)), "amount", "balance", "fixed"
    )


def scale_minmax(spark, d):
    return _rounded(practices.min_max_scaling(_rows(spark, d), APPLICANT), *NUMBERS, "sex")


def stratified_sample(spark, d):
    """One group per nation; rows whose group is missing vanish."""
    rows = gappy(spark, d).select("row_id", "amount", "segment")
    return practices.stratified_sampling(rows, Roles("row_id", "amount", "segment"))


def undersample(spark, d):
    return practices.undersampling(applicants(spark, d).select("row_id", "amount", "nation"), NATION)


def undersample_ages(spark, d):
    """Every distinct age is a group of its own."""
    rows = applicants(spark, d).select("row_id", "amount", "age")
    return practices.undersampling(rows, APPLICANT.with_(protected="age"))


def oversample(spark, d):
    return practices.oversampling(applicants(spark, d).select("row_id", "amount", "sex"), APPLICANT)


def oversample_segments(spark, d):
    rows = applicants(spark, d).select("row_id", "balance", "segment")
    return practices.oversampling(rows, Roles("row_id", "target", "segment"))


def kmeans_cluster(spark, d):
    rows = _rows(spark, d).select("row_id", "amount", "balance", "age", "sex", "target")
    return practices.clustering(rows, APPLICANT).groupBy("Cluster").agg(
        F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("mean_amount")
    )


def kmeans_assign(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    centres = [[10.0, 20000.0], [40.0, 60000.0]]
    return practices.assign_to_centroids(line, ["l_quantity", "l_extendedprice"], centres)


def kmeans_step(spark, d):
    """Means of the 64 embedding dimensions around two given centres."""
    e = table(spark, d, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    rows = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    step = practices.centroid_step(rows, cols, [[0.05] * 64, [-0.05] * 64])
    return step.select("Cluster", "n", *[r6(c) for c in cols])


def ipw_weight(spark, d):
    rows = applicants(spark, d).select("row_id", "nation")
    return _rounded(practices.ipw(rows, NATION), "Weight")


def shuffle_rows(spark, d):
    return practices.shuffle_key(applicants(spark, d).select("row_id", "segment"), APPLICANT)


def practices_subset(spark, d):
    """Five practices in order, including a name that does not exist."""
    steps = ["standard", "undersampling", "unknown", "ipw", "matching", "min_max_scaling"]
    rows = applicants(spark, d).select("row_id", "amount", "age", "sex", "target")
    done = practices.apply_practices(rows, steps, APPLICANT)
    return _rounded(done, "amount", "age", "sex", "target", "Weight")


def practices_all(spark, d):
    """All eight in catalogue order; what the clusters do not touch is checked by SQL."""
    rows = applicants(spark, d).select("row_id", "amount", "age", "sex", "target")
    done = practices.apply_practices(rows, TECHNIQUES, APPLICANT)
    return done.select("row_id", r6("amount"), r6("age"), r6("sex"), r6("target"), r6("Weight"))


def practices_resampled(spark, d):
    """Draw up, then cut down: the second sampler works on drawn identifiers."""
    rows = applicants(spark, d).select("row_id", "amount", "segment", "sex")
    up = practices.apply_practices(rows, ["oversampling", "min_max_scaling"], APPLICANT)
    down = practices.apply_practices(up, "stratified_sampling", APPLICANT.with_(protected="segment"))
    return _rounded(down, "amount", "sex")


QUERIES = {
    f.__name__: f
    for f in (
        scale_standard, scale_standard_gaps, scale_minmax, stratified_sample, undersample,
        undersample_ages, oversample, oversample_segments, kmeans_cluster, kmeans_assign,
        kmeans_step, ipw_weight, shuffle_rows, practices_subset, practices_all, practices_resampled,
    )
}


def _z(c: str) -> str:
    return f"round(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 6) + 0.0 as {c}"


def _mm(c: str, rounded: bool = True, src: str = "") -> str:
    e = f"coalesce(({c} - min({c}) over ()) / nullif((max({c}) over () - min({c}) over ())::double, 0), 0.0::double)"
    return f"round({e}, 6) as {c}" if rounded else f"{e} as {c}"


def sample_sql(source: str, group: str, seed: int) -> str:
    """Rows of ``source`` cut to the smallest group's size by hash order."""
    return f"""(select * exclude (n_, r_) from (
    select *, count(*) over (partition by {group}) as n_,
      row_number() over (partition by {group} order by {h_sql(seed, 'row_id')}, row_id) as r_
    from {source}) where r_ <= (select min(n) from (select count(*) as n from {source} group by {group})))"""


def draw_sql(source: str, group: str, cols: str, seed: int, n_draws: str = "max(n) over ()", low: str = "0") -> str:
    """Draws with replacement from every group of ``source``, named <row_id>#<i>."""
    return f"""(select r.row_id || '#' || d.i as row_id, {cols} from (
    select {group}, n, unnest(range(0, (m - {low})::bigint)) as i from (
      select {group}, count(*) as n, max(count(*)) over () as m from {source} group by {group})) d
  join (select *, row_number() over (partition by {group} order by {h_sql(f'{seed}:rank', 'row_id')}, row_id) as rank_ from {source}) r
    on r.{group} = d.{group} and r.rank_ = 1 + {h60_sql(seed, 'd.' + group, 'd.i')} % d.n)"""


_SMALL = "a as (select row_id, amount, age, sex, target from applicants)"
_STD = "s as (select row_id, (amount - avg(amount) over ()) / stddev_pop(amount) over () as amount, (age - avg(age) over ()) / stddev_pop(age) over () as age, sex, (target - avg(target) over ()) / stddev_pop(target) over () as target from a)"

SQL = {
    "scale_standard": f"with {APPLICANTS} select row_id, {', '.join(_z(c) for c in NUMBERS)}, segment, sex from applicants",
    "scale_standard_gaps": f"with {GAPPY} select row_id, {_z('amount')}, {_z('balance')}, 0.0::double as fixed, target, sex from gappy",
    "scale_minmax": f"with {APPLICANTS} select row_id, segment, {', '.join(_mm(c) for c in [*NUMBERS, 'sex'])} from applicants",
    "stratified_sample": f"""with {GAPPY}, g as (select row_id, amount, segment from gappy where segment is not null)
select * from {sample_sql('g', 'segment', 42)}""",
    "undersample": f"with {APPLICANTS}, g as (select row_id, amount, nation from applicants) select * from {sample_sql('g', 'nation', 123)}",
    "undersample_ages": f"with {APPLICANTS}, g as (select row_id, amount, age from applicants) select * from {sample_sql('g', 'age', 123)}",
    "oversample": f"with {APPLICANTS} select * from {draw_sql('applicants', 'sex', 'amount, r.sex', 123)}",
    "oversample_segments": f"with {APPLICANTS} select * from {draw_sql('applicants', 'segment', 'balance, r.segment', 123)}",
    "kmeans_assign": """select l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  case when pow(l_quantity - 10.0, 2) + pow(l_extendedprice - 20000.0, 2) <= pow(l_quantity - 40.0, 2) + pow(l_extendedprice - 60000.0, 2)
  then 0 else 1 end as "Cluster" from lineitem""",
    "kmeans_step": "with e as (select vec_id, "
    + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(64))
    + " from embeddings), a as (select *, case when "
    + " + ".join(f"pow(e{i} - 0.05, 2)" for i in range(64))
    + " <= "
    + " + ".join(f"pow(e{i} + 0.05, 2)" for i in range(64))
    + ' then 0 else 1 end as "Cluster" from e) select "Cluster", count(*) as n, '
    + ", ".join(f"round(avg(e{i}), 6) as e{i}" for i in range(64))
    + ' from a group by "Cluster"',
    "ipw_weight": f"""with {APPLICANTS}
select row_id, nation, round(count(*) over () / (count(*) over (partition by nation))::double, 6) as "Weight" from applicants""",
    "shuffle_rows": f"with {APPLICANTS} select row_id, segment, {h_sql(42, 'row_id')} as shuffle_key from applicants",
    "practices_subset": f"""with {APPLICANTS}, {_SMALL}, {_STD}, u as {sample_sql('s', 'sex', 123)},
w as (select *, count(*) over () / (count(*) over (partition by sex))::double as "Weight" from u)
select row_id, {', '.join(_mm(c) for c in ('amount', 'age', 'sex', 'target', '"Weight"'))} from w""",
    "practices_all": f"""with {APPLICANTS}, {_SMALL}, {_STD}, t as {sample_sql('s', 'sex', 42)},
o as {draw_sql('t', 'sex', 'amount, age, r.sex, target', 123)}, u as {sample_sql('o', 'sex', 123)},
w as (select *, count(*) over () / (count(*) over (partition by sex))::double as "Weight" from u)
select row_id, {', '.join(_mm(c) for c in ('amount', 'age', 'sex', 'target', '"Weight"'))} from w""",
    "practices_resampled": f"""with {APPLICANTS}, o as {draw_sql('applicants', 'sex', 'amount, segment, r.sex', 123)},
m as (select row_id, {_mm('amount', False)}, segment, {_mm('sex', False)} from o)
select row_id, round(amount, 6) as amount, segment, round(sex, 6) as sex from {sample_sql('m', 'segment', 42)}""",
}
