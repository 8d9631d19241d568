"""The shared tables in the roles the operators need, for Spark and as SQL text.

Each view exists twice with the same columns: a function for Spark and a common table
expression for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash32
from evenkeel.roles import TECHNIQUES, Roles


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def h_sql(seed: str | int, *parts: str) -> str:
    """SQL text of :func:`hash32`."""
    text = "".join(f" || ':' || {p}" for p in parts)
    return f"(('0x' || substr(md5('{seed}'{text}), 1, 8))::bigint)"


def h60_sql(seed: str | int, *parts: str) -> str:
    """SQL text of :func:`hash60`."""
    return h_sql(seed, *parts).replace(", 1, 8)", ", 1, 15)")


def u_sql(seed: str | int, *parts: str) -> str:
    return f"({h_sql(seed, *parts)} / 4294967296.0::double)"


# ------------------------------------------------------------------ applicants (orders)

APPLICANT = Roles(row_id="row_id", target="target", protected="sex")


def applicants(spark: SparkSession, d: str) -> DataFrame:
    """One labelled row per order, with its customer's attributes."""
    return spark_applicants(table(spark, d, "orders"), table(spark, d, "customer"))


def spark_applicants(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        (18 + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.when(F.col("c_nationkey") % 3 == 0, 1).otherwise(0).alias("sex"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
    )


APPLICANTS = """applicants as (
  select o_orderkey as row_id, o_totalprice as amount, c_acctbal as balance,
         c_nationkey as nation, c_mktsegment as segment, o_orderpriority as priority,
         (18 + c_custkey % 60)::int as age,
         case when c_nationkey % 3 = 0 then 1 else 0 end as sex,
         case when o_orderstatus = 'F' then 1 else 0 end as target
  from orders join customer on o_custkey = c_custkey)"""


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """Applicants with missing values, an empty column and some missing labels."""
    df = applicants(spark, d)
    return df.select(
        "row_id",
        F.when(~((F.col("priority") == "5-LOW") & (F.col("nation") % 5 == 0)), F.col("amount")).alias("amount"),
        F.when(F.col("age") % 10 != 0, F.col("balance")).alias("balance"),
        F.lit(None).cast("double").alias("blank"),
        F.when(F.col("nation") != 7, F.col("segment")).alias("segment"),
        F.when(F.col("nation") != 11, F.col("priority")).alias("priority"),
        "age",
        F.when(F.col("nation") != 13, F.col("sex")).alias("sex"),
        F.when(F.col("nation") != 17, F.col("target")).alias("target"),
    )


GAPPY = APPLICANTS + """, gappy as (
  select row_id,
         case when not (priority = '5-LOW' and nation % 5 = 0) then amount end as amount,
         case when age % 10 <> 0 then balance end as balance,
         cast(null as double) as blank,
         case when nation <> 7 then segment end as segment,
         case when nation <> 11 then priority end as priority,
         age,
         case when nation <> 13 then sex end as sex,
         case when nation <> 17 then target end as target
  from applicants)"""


# --------------------------------------------------------------- predictions (lineitem)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One prediction per order line for 21 runs (model x variant), five folds.

    Variant 7 never favours the privileged group (unbounded impact), variant 6 favours
    nobody (undefined impact), variant 5 has labels of one class only.
    """
    line = table(spark, d, "lineitem")
    s = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    nobody = (F.col("l_linenumber") == 6) | ((F.col("l_linenumber") == 7) & (s == 1))
    rid = F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return line.select(
        rid.alias("row_id"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linenumber").alias("variant"),
        F.pmod(hash32(42, rid), F.lit(5)).cast("int").alias("fold"),
        F.when((F.col("l_linenumber") == 5) | (F.col("l_quantity") > 25), 1)
        .otherwise(0)
        .alias("y"),
        s.alias("s"),
        F.col("l_discount").alias("score"),
        F.when(~nobody & (F.col("l_discount") >= 0.05), 1).otherwise(0).alias("pred"),
    )


_RID = "(l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber)"
PREDICTIONS = f"""predictions as (
  select {_RID} as row_id, l_returnflag as model, l_linenumber as variant,
         ({h_sql(42, _RID)} % 5)::int as fold,
         case when l_linenumber = 5 or l_quantity > 25 then 1 else 0 end as y,
         case when l_linestatus = 'O' then 1 else 0 end as s,
         l_discount as score,
         case when l_linenumber = 6 or (l_linenumber = 7 and l_linestatus = 'O') then 0
              when l_discount >= 0.05 then 1 else 0 end as pred
  from lineitem)"""


# ------------------------------------------------------------------------ runs (events)

_POP = [5, 10, 15, 20, 50, 100]


def _pick(values: list, index) -> F.col:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One finished run per event, with failures, infeasible runs and ties."""
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    failed = i % 101 == 0
    model = _pick(["rf", "lr", "svc", "xgb"], u % 4)
    return e.select(
        i.alias("ord"),
        F.concat(F.lit("datasets/"), F.col("event_type"), F.lit(".csv")).alias("dataset"),
        model.alias("model_identifier"),
        F.when(u % 2 == 0, "sex").otherwise("age").alias("protected_attribute"),
        _pick(_POP, i % 6).alias("population_size"),
        _pick(_POP, F.floor(i / 6) % 6).alias("generations"),
        ((i % 5) * F.lit(0.25)).alias("alpha"),
        ((F.floor(i / 5) % 5) * F.lit(0.25)).alias("beta"),
        F.concat(F.lit('["t'), (i % 8).cast("string"), F.lit('"]')).alias("techniques"),
        F.when(~failed, model).alias("model_used"),
        F.when(failed, F.lit(None).cast("double"))
        .when(i % 97 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value") / 100)
        .alias("fitness"),
        F.when(~failed & (i % 97 != 0), (i * 37 % 1000) / F.lit(1000.0)).alias("fairness_score"),
        F.when(~failed, (i * 53 % 1000) / F.lit(1000.0)).alias("performance_score"),
        (F.col("value") * 2).alias("elapsed_seconds"),
        F.when(failed, F.lit("ValueError: bad input")).alias("error"),
    )


RUNS = """runs as (
  select event_id as ord,
         'datasets/' || event_type || '.csv' as dataset,
         (['rf','lr','svc','xgb'])[(user_id % 4 + 1)::int] as model_identifier,
         case when user_id % 2 = 0 then 'sex' else 'age' end as protected_attribute,
         ([5,10,15,20,50,100])[(event_id % 6 + 1)::int] as population_size,
         ([5,10,15,20,50,100])[((event_id // 6) % 6 + 1)::int] as generations,
         (event_id % 5) * 0.25::double as alpha,
         ((event_id // 5) % 5) * 0.25::double as beta,
         '["t' || (event_id % 8) || '"]' as techniques,
         case when event_id % 101 <> 0 then (['rf','lr','svc','xgb'])[(user_id % 4 + 1)::int] end as model_used,
         case when event_id % 101 = 0 then null when event_id % 97 = 0 then '-inf'::double
              else value / 100 end as fitness,
         case when event_id % 101 <> 0 and event_id % 97 <> 0 then (event_id * 37 % 1000) / 1000.0::double end as fairness_score,
         case when event_id % 101 <> 0 then (event_id * 53 % 1000) / 1000.0::double end as performance_score,
         value * 2 as elapsed_seconds,
         case when event_id % 101 = 0 then 'ValueError: bad input' end as error
  from events)"""

# runs whose infinities are NULL, as the summaries expect them
CLEAN_RUNS = RUNS + """, clean as (
  select * replace (case when isinf(fitness) then null else fitness end as fitness) from runs)"""


def static_scores(spark: SparkSession, d: str) -> DataFrame:
    """Baseline rows (all / none) per dataset, attribute and model, from the events."""
    r = runs(spark, d).filter("error is null")
    return r.select(
        F.regexp_extract("dataset", r"([a-z_]+)\.csv", 1).alias("dataset"),
        "protected_attribute",
        F.when(F.col("model_identifier") == "svc", "svm")
        .otherwise(F.col("model_identifier"))
        .alias("model"),
        F.when(F.col("ord") % 2 == 0, "all").otherwise("none").alias("baseline"),
        (F.col("performance_score") / 2 + F.col("ord") % 3).alias("fitness"),
        F.col("fairness_score").alias("fairness"),
        F.col("performance_score").alias("performance"),
    ).filter(~((F.col("dataset") == "error") & (F.col("baseline") == "none")))


STATIC = RUNS + """, static_scores as (
  select regexp_extract(dataset, '([a-z_]+)\\.csv', 1) as dataset, protected_attribute,
         case when model_identifier = 'svc' then 'svm' else model_identifier end as model,
         case when ord % 2 = 0 then 'all' else 'none' end as baseline,
         performance_score / 2 + ord % 3 as fitness,
         fairness_score as fairness, performance_score as performance
  from runs where error is null
   and not (regexp_extract(dataset, '([a-z_]+)\\.csv', 1) = 'error' and ord % 2 = 1))"""


# ------------------------------------------------------- method results (orders, customer)

PAIR_KEYS = ["dataset_name", "protected_attribute", "model_identifier"]
TREATMENT = "1-URGENT"
DIRECTIONS = {
    "fairness_score": "lower",
    "performance_score": "higher",
    "elapsed_seconds": "lower",
}


def methods(spark: SparkSession, d: str) -> DataFrame:
    """Archived-looking results: one row per nation and order priority."""
    df = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return df.groupBy("c_nationkey", "o_orderpriority").agg(
        F.round(F.avg(F.col("o_totalprice") / 500000), 9).alias("performance_score"),
        F.round(F.avg((F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0)), 9).alias("fairness_score"),
        F.round(F.avg(F.col("o_custkey") % 97 + F.col("c_acctbal") / 10000), 9).alias("elapsed_seconds"),
    ).select(
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("dataset_name"),
        F.lit("sex").alias("protected_attribute"),
        F.lit("lr").alias("model_identifier"),
        F.col("o_orderpriority").alias("method"),
        "performance_score",
        "fairness_score",
        "elapsed_seconds",
    )


METHOD_ROWS = """methods as (
  select 'nation' || c_nationkey as dataset_name, 'sex' as protected_attribute,
         'lr' as model_identifier, o_orderpriority as method,
         round(avg(o_totalprice / 500000), 9) as performance_score,
         round(avg((o_orderkey * 7919 % 1000) / 1000.0::double), 9) as fairness_score,
         round(avg(o_custkey % 97 + c_acctbal / 10000), 9) as elapsed_seconds
  from orders join customer on o_custkey = c_custkey
  group by c_nationkey, o_orderpriority),
long_methods as (
  select * from methods unpivot (v for metric in (performance_score, fairness_score, elapsed_seconds))),
pairs as (
  select y.metric, y.method as baseline, y.dataset_name, y.protected_attribute,
         y.model_identifier, x.v as x, y.v as y, x.v - y.v as d
  from long_methods y join long_methods x using (metric, dataset_name, protected_attribute, model_identifier)
  where x.method = '1-URGENT' and y.method <> '1-URGENT')"""


# ------------------------------------------------------------ score store (orders)

NAMES_SQL = (
    "(['standard','stratified_sampling','oversampling','undersampling','clustering','ipw',"
    "'matching','min_max_scaling'])"
)


def stored_text(spark: SparkSession, d: str) -> DataFrame:
    """Stored score rows as text, many per key, one or two practices each."""
    o = table(spark, d, "orders")
    h = hash32("store", "o_orderkey")
    a, b = _pick(TECHNIQUES, h % 8), _pick(TECHNIQUES, F.floor(h / 8) % 8)
    single = (a == b) | (F.floor(h / 64) % 2 == 0)
    price = F.col("o_totalprice").cast("string")
    return o.select(
        F.col("o_orderkey").alias("ord"),
        F.lit("d").alias("dataset"),
        _pick(["rf", "lr", "svc", "xgb"], F.col("o_custkey") % 4).alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, "sex").otherwise("age").alias("protected_attribute"),
        F.lit("y").alias("target_column"),
        F.when(F.floor(h / 128) % 50 == 0, F.lit(""))
        .when(single, F.concat(F.lit('["'), a, F.lit('"]')))
        .otherwise(F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('"]')))
        .alias("techniques"),
        F.when(F.col("o_orderstatus") == "P", "NaN")
        .when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), "")
        .otherwise(price)
        .alias("fitness"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(price).alias("fairness"),
        price.alias("performance"),
    )


STORE_TEXT = f"""stored_text as (
  select o_orderkey as ord, 'd' as dataset,
         (['rf','lr','svc','xgb'])[(o_custkey % 4 + 1)::int] as model,
         case when o_orderkey % 2 = 0 then 'sex' else 'age' end as protected_attribute,
         'y' as target_column,
         case when (h // 128) % 50 = 0 then ''
              when a = b or (h // 64) % 2 = 0 then '["' || a || '"]'
              else '["' || a || '","' || b || '"]' end as techniques,
         case when o_orderstatus = 'P' then 'NaN'
              when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then ''
              else o_totalprice::varchar end as fitness,
         case when o_orderpriority = '1-URGENT' then '' else o_totalprice::varchar end as fairness,
         o_totalprice::varchar as performance
  from (select *, {NAMES_SQL}[(h % 8 + 1)::int] as a, {NAMES_SQL}[((h // 8) % 8 + 1)::int] as b
        from (select *, {h_sql('store', 'o_orderkey')} as h from orders)))"""


# ------------------------------------------------------------- populations (customer)


def search_runs(spark: SparkSession, d: str) -> DataFrame:
    """One search run per customer with its own size and rates."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("run_id"),
        F.lit("d").alias("dataset"),
        _pick(["rf", "lr", "svc", "xgb"], k % 4).alias("model"),
        F.when(k % 2 == 0, "sex").otherwise("age").alias("protected_attribute"),
        F.lit("y").alias("target_column"),
        _pick([1, 3, 5, 8, 10], k % 5).alias("population_size"),
        _pick([1, 2, 3], k % 3).alias("generations"),
        (F.floor(k / 2) % 5 * F.lit(0.25)).alias("alpha"),
        (F.floor(k / 3) % 5 * F.lit(0.25)).alias("beta"),
    )


RUN_COLS = [
    "run_id", "dataset", "model", "protected_attribute", "target_column",
    "population_size", "generations", "alpha", "beta",
]

POPULATION = f"""search_runs as (
  select c_custkey as run_id, 'd' as dataset,
         (['rf','lr','svc','xgb'])[(c_custkey % 4 + 1)::int] as model,
         case when c_custkey % 2 = 0 then 'sex' else 'age' end as protected_attribute,
         'y' as target_column,
         ([1,3,5,8,10])[(c_custkey % 5 + 1)::int] as population_size,
         ([1,2,3])[(c_custkey % 3 + 1)::int] as generations,
         (c_custkey // 2) % 5 * 0.25::double as alpha,
         (c_custkey // 3) % 5 * 0.25::double as beta
  from customer),
slots as (select *, unnest(range(1, population_size + 1))::int as slot from search_runs),
sized as (select *, 1 + floor({u_sql('42:init:size', 'run_id', 'slot')} * 8)::int as k from slots),
genes as (select s.*, n.name, {h_sql('42:init:order', 'run_id', 'slot', 'n.name')} as h
          from sized s, (select unnest({NAMES_SQL}) as name) n),
ranked_genes as (select *, row_number() over (partition by run_id, slot order by h, name) as r from genes),
population as (
  select run_id, slot, any_value(dataset) as dataset, any_value(model) as model,
         any_value(protected_attribute) as protected_attribute, any_value(target_column) as target_column,
         any_value(population_size) as population_size, any_value(generations) as generations,
         any_value(alpha) as alpha, any_value(beta) as beta,
         list(name order by r) as techniques
  from ranked_genes where r <= k group by run_id, slot)"""
