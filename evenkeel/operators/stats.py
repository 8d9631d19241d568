"""Paired non-parametric comparisons of methods, all hypotheses in one grouped plan.

Tables of pairs have the hypothesis key columns plus ``x`` (treatment) and ``y``
(baseline). Everything that grows with the number of pairs runs as grouped aggregates; the
final statistics of a hypothesis become a p-value in column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash60
from evenkeel.operators.joins import attach, explode_range, keyed_join
from evenkeel.operators.lineage import cut_lineage
from evenkeel.operators.ordering import (
    exact_quantiles,
    hash_rank,
    prefix_sums,
    running_max,
    value_cells,
)

# Level and replicates of the study.
ALPHA = 0.05
REPLICATES = 10_000
SEED = 20260930
#: Method "auto" takes the exact signed-rank distribution up to this many pairs.
EXACT_PAIRS = 50

HYPOTHESIS = ["metric", "baseline"]


def paired_values(
    results: DataFrame,
    keys: list[str],
    method: str,
    treatment: str,
    baselines: list[str],
    metrics: list[str],
) -> DataFrame:
    """(metric, baseline, keys, x, y): means of treatment and baseline where both exist."""
    names = [treatment, *baselines]
    rows = results.filter(F.col(method).isin(*names))
    found = {r[method] for r in rows.select(method).distinct().collect()}
    missing = sorted(set(names) - found)
    if missing:
        raise KeyError(f"method(s) {missing} missing")
    means = (
        rows.dropna(subset=keys)
        .groupBy(*keys, method)
        .agg(*[F.avg(m).cast("double").alias(m) for m in metrics])
    )
    long = means.unpivot([*keys, method], metrics, "metric", "v").filter("v is not null")
    x = long.filter(F.col(method) == treatment).select("metric", *keys, F.col("v").alias("x"))
    y = long.filter(F.col(method) != treatment).select(
        "metric", F.col(method).alias("baseline"), *keys, F.col("v").alias("y")
    )
    return y.join(x, ["metric", *keys]).select("metric", "baseline", *keys, "x", "y")


# ------------------------------------------------------------------------ effect size


def a12(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of (x, y) combinations with x above y, ties counting one half."""
    values = pairs.select(*keys, "x", "y").unpivot(keys, ["x", "y"], "side", "v")
    counts = values.groupBy(*keys, "v").agg(
        F.count_if(F.col("side") == "x").alias("nx"), F.count_if(F.col("side") == "y").alias("ny")
    )
    placed = prefix_sums(counts, keys, "v", ["nx", "ny"], value_cells(values, "v"))
    wins = F.col("nx") * (F.col("before_ny") + F.col("ny") / 2)
    return placed.groupBy(*keys).agg(
        (F.sum(wins) / (F.max("total_nx").cast("double") * F.max("total_ny"))).alias("a12_raw")
    )


# ------------------------------------------------------------------------- signed rank


def signed_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank sums of x - y with average ranks; zero differences are discarded."""
    d = F.col("x") - F.col("y")
    nonzero = pairs.filter(d != 0).select(*keys, F.abs(d).alias("v"), (d > 0).alias("up"))
    counts = nonzero.groupBy(*keys, "v").agg(
        F.count("*").alias("n"), F.count_if("up").alias("n_up")
    )
    placed = prefix_sums(counts, keys, "v", ["n"], value_cells(nonzero, "v"))
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n_used"),
        F.sum(F.col("n_up") * rank).alias("w_plus"),
        F.sum((F.col("n") - F.col("n_up")) * rank).alias("w_minus"),
        F.sum(n * n * n - n).alias("tie_term"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal, by Simpson's rule over twelve deviations."""
    steps, width = 4_000, 0.003
    weight = lambda i: F.when(i.isin(0, steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    density = lambda i: F.exp(-F.pow(F.abs(z) + i * width, 2) / 2)
    area = _sum(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: weight(i) * density(i)))
    return 2 * area * F.lit(width / 3 / math.sqrt(2 * math.pi))


def exact_signed_rank(n: Column, w: Column) -> Column:
    """Two-sided exact p of the smaller rank sum ``w``.

    Counts the subsets of 1..n by their sum, adding one rank at a time: n^3 steps for n pairs.
    """
    size = F.greatest(n, F.lit(1)).cast("int")
    ways = F.aggregate(
        F.sequence(F.lit(1), size),
        F.array(F.lit(1.0)),
        lambda acc, k: F.transform(
            F.sequence(F.lit(0), F.size(acc) + k - 1),
            lambda i: F.coalesce(F.get(acc, i), F.lit(0.0)) + F.coalesce(F.get(acc, i - k), F.lit(0.0)),
        ),
    )
    below = F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1)
    return F.least(F.lit(1.0), 2 * _sum(below) / F.pow(F.lit(2.0), size))


def signed_rank_method(n: Column, ties: Column, zeros: Column, method: str = "auto") -> Column:
    """'exact' or 'normal'. Ties and zeros have no exact distribution, so they are always normal."""
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method}")
    clean = (ties == 0) & (zeros == 0)
    exact = F.lit(False) if method == "normal" else clean & (n <= EXACT_PAIRS) if method == "auto" else clean
    return F.when(exact, "exact").otherwise("normal")


def signed_rank_p(n: Column, w_plus: Column, w_minus: Column, ties: Column, method: Column) -> Column:
    """Exact p-value, or normal with tie correction, as ``method`` says."""
    m = n.cast("double")
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24)
    z = F.try_divide(w_plus - m * (m + 1) / 4, spread)
    return (
        F.when(n == 0, F.lit(1.0))
        .when(method == "exact", exact_signed_rank(n, F.least(w_plus, w_minus)))
        .otherwise(normal_tail(z))
    )


def signed_rank_test(pairs: DataFrame, keys: list[str], method: str = "auto") -> DataFrame:
    """Two-sided signed-rank test per hypothesis; ``p_method`` names the distribution used.

    ``method`` is 'exact' (for any number of pairs), 'normal', or 'auto': exact up to ``EXACT_PAIRS``.
    """
    zeros = pairs.groupBy(*keys).agg(F.count_if(F.col("x") == F.col("y")).alias("n_zero"))
    full = keyed_join(zeros, signed_ranks(pairs, keys), keys, "left").fillna(
        0, ["n_used", "w_plus", "w_minus", "tie_term"]
    )
    n, ties = F.col("n_used"), F.col("tie_term")
    full = full.withColumn("p_method", signed_rank_method(n, ties, F.col("n_zero"), method))
    return full.withColumn("p_value", signed_rank_p(n, F.col("w_plus"), F.col("w_minus"), ties, F.col("p_method")))


# ---------------------------------------------------------------------------- sign test


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 11, stepped back by exact factors."""
    x = n.cast("double") + 11
    series = (
        (x - 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    factors = F.lit(1.0)
    for i in range(1, 11):
        factors = factors * (n.cast("double") + i)
    return series - F.ln(factors)


def sign_p(up: Column, n: Column) -> Column:
    """Exact two-sided binomial(1/2) tail.

    The largest term comes from factorials; the others follow by ratios, as far out as they
    can matter.
    """
    k = F.least(up, n - up)
    lead = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.lit(math.log(2))
    reach = F.least(k, F.ceil(20 * F.sqrt(n)) + 50).cast("int")
    ratios = F.transform(F.sequence(F.lit(0), reach), lambda i: (k - i) / (n - k + i + 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    tail = F.aggregate(
        ratios,
        start,
        lambda acc, q: F.struct(
            (acc["term"] * q).alias("term"), (acc["total"] + acc["term"]).alias("total")
        ),
    )["total"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(lead) * tail))


def sign_test(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact two-sided sign test of x - y; zero differences are discarded."""
    counts = pairs.groupBy(*keys).agg(
        F.count_if(F.col("x") > F.col("y")).alias("n_up"),
        F.count_if(F.col("x") != F.col("y")).alias("n_used"),
    )
    return counts.withColumn("sign_p", sign_p(F.col("n_up"), F.col("n_used")))


# ------------------------------------------------------------------------------ symmetry


def _symmetry(n: Column, mean: Column, median: Column, spread: Column) -> Column:
    scaled = F.lit(math.sqrt(math.pi / 2)) * spread
    return F.when(spread == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.sqrt(n) * (mean - median), scaled)
    )


def difference_counts(diffs: DataFrame, keys: list[str]) -> DataFrame:
    return diffs.groupBy(*keys, "d").agg(F.count("*").alias("w"))


def symmetry_statistic(counts: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(n) (mean - median) / (sqrt(pi/2) mean|d - median|) of column ``d``; 0 if constant.

    ``counts`` comes from :func:`difference_counts`.
    """
    medians = exact_quantiles(counts, keys, "d", {"median": 0.5}, "w")
    sums = keyed_join(counts, medians, keys).groupBy(*keys).agg(
        F.sum("w").alias("n"),
        F.max("median").alias("median"),
        (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("mean"),
        (F.sum(F.abs(F.col("d") - F.col("median")) * F.col("w")) / F.sum("w")).alias("spread"),
    )
    stat = _symmetry(F.col("n"), F.col("mean"), F.col("median"), F.col("spread"))
    return sums.select(*keys, "n", "median", stat.alias("symmetry_stat"))


def symmetry_test(
    diffs: DataFrame,
    keys: list[str],
    row_id: str,
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """Bootstrap p-value of the symmetry statistic, per hypothesis.

    Replicates draw n values from the sample reflected about its median. Draw ``pos`` of
    replicate ``rep`` takes pool position hash(seed, keys, rep, pos) mod 2n, positions
    being hash ranks of ``row_id``, then their mirror images.
    """
    observed = cut_lineage(symmetry_statistic(difference_counts(diffs, keys), keys))
    ranked = keyed_join(hash_rank(diffs, keys, row_id, seed, "__rank"), observed, keys)
    centred = F.col("d") - F.col("median")
    one = F.lit(1).cast("bigint")
    pool = ranked.select(
        *keys,
        F.explode(
            F.array(
                F.struct((F.col("__rank") - 1).alias("idx"), centred.alias("d")),
                F.struct((F.col("__rank") - 1 + F.col("n")).alias("idx"), (-centred).alias("d")),
            )
        ).alias("e"),
    ).select(*keys, "e.idx", "e.d", one.alias("w"))
    draws = explode_range(
        observed.select(*keys, "n"), F.col("n") * F.lit(replicates), "__i"
    ).withColumns(
        {"rep": F.floor(F.col("__i") / F.col("n")), "pos": F.pmod(F.col("__i"), F.col("n"))}
    )
    indexed = draws.select(
        *keys, "rep", F.pmod(hash60(seed, *keys, "rep", "pos"), 2 * F.col("n")).alias("idx"), "__i"
    )
    sample = attach(indexed, pool, [*keys, "idx"], "w", F.col("__i")).select(*keys, "rep", "d")
    drawn = cut_lineage(difference_counts(sample, [*keys, "rep"]))
    null = symmetry_statistic(drawn, [*keys, "rep"]).select(
        *keys, F.col("symmetry_stat").alias("t")
    )
    limit = observed.select(*keys, F.abs("symmetry_stat").alias("limit"))
    beyond = keyed_join(null, limit, keys).groupBy(*keys).agg(
        F.count_if(F.abs("t") >= F.col("limit")).alias("n_beyond")
    )
    return keyed_join(observed, beyond, keys).select(
        *keys,
        "symmetry_stat",
        "n_beyond",
        ((F.col("n_beyond") + 1) / F.lit(replicates + 1)).alias("symmetry_p"),
    )


# -------------------------------------------------------------------------- corrections


def holm_adjust(table: DataFrame, family: list[str], p: str, row_id: Column, out: str) -> DataFrame:
    """Step-down adjusted p-values within each family: running max of (m - rank) p, at most 1.

    Equal p-values get equal results, so the work is done per distinct p-value.
    """
    family_key = family or ["__family"]
    base = table if family else table.withColumn("__family", F.lit(0))
    counts = base.groupBy(*family_key, p).agg(F.count("*").alias("n"))
    bounds = value_cells(base, p)
    placed = prefix_sums(counts, family_key, p, ["n"], bounds)
    raised = placed.withColumn("__raw", (F.col("total_n") - F.col("before_n")) * F.col(p))
    stepped = running_max(raised, family_key, p, "__raw", bounds, "__adj").select(
        *family_key, p, F.col("n").alias("__n"), F.least(F.col("__adj"), F.lit(1.0)).alias(out)
    )
    return attach(base, stepped, [*family_key, p], "__n", row_id).select(*table.columns, out)


def winner(significant: Column, effect: Column) -> Column:
    """Direction of a comparison: only a significant one names a side."""
    return (
        F.when(~significant, "No_diff")
        .when(effect > 0.5, "Treatment_better")
        .when(effect < 0.5, "Baseline_better")
        .otherwise("Tie")
    )


# ------------------------------------------------------------------------------- tables


def compare_methods(
    results: DataFrame,
    keys: list[str],
    method: str,
    treatment: str,
    baselines: list[str],
    directions: dict[str, str],
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """One row per (metric, baseline) with means, tests and the oriented effect size.

    ``directions`` maps each metric to 'lower' or 'higher' (which one is better).
    """
    metrics = list(directions)
    pairs = cut_lineage(paired_values(results, keys, method, treatment, baselines, metrics))
    means = pairs.groupBy(*HYPOTHESIS).agg(
        F.count("*").alias("n_pairs"),
        F.avg("x").alias("treatment_mean"),
        F.avg("y").alias("baseline_mean"),
    )
    diffs = pairs.select(
        *HYPOTHESIS, F.concat_ws("|", *keys).alias("pair"), (F.col("x") - F.col("y")).alias("d")
    )
    parts = [
        signed_rank_test(pairs, HYPOTHESIS).select(*HYPOTHESIS, "p_value"),
        a12(pairs, HYPOTHESIS),
        symmetry_test(diffs, HYPOTHESIS, "pair", replicates, seed).drop("n_beyond"),
        sign_test(pairs, HYPOTHESIS).select(*HYPOTHESIS, "sign_p"),
    ]
    table = means
    for part in parts:
        table = keyed_join(table, part, HYPOTHESIS)
    direction = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])[F.col("metric")]
    effect = F.when(direction == "higher", F.col("a12_raw")).otherwise(1.0 - F.col("a12_raw"))
    return table.withColumns({"direction": direction, "a12_effective": effect})


def hypothesis_table(
    comparison: DataFrame, alpha: float = ALPHA, labels: dict[tuple[str, str], str] | None = None
) -> DataFrame:
    """Add family-wise corrections and decisions to :func:`compare_methods` rows.

    ``labels`` names the hypothesis of each (metric, baseline) in a first column; one without a name stays NULL.
    """
    if labels is not None:
        name = F.lit(None).cast("string")
        for (metric, baseline), label in labels.items():
            name = F.when((F.col("metric") == metric) & (F.col("baseline") == baseline), label).otherwise(name)
        comparison = comparison.select(name.alias("hypothesis"), *comparison.columns)
    spread = F.concat_ws("|", *HYPOTHESIS)
    table = holm_adjust(cut_lineage(comparison), [], "p_value", spread, "p_holm")
    table = holm_adjust(table, [], "sign_p", spread, "sign_p_holm")
    significant = F.col("p_holm") < alpha
    return table.withColumns(
        {
            "symmetric": F.col("symmetry_p") >= alpha,
            "significant": significant,
            "sign_significant": F.col("sign_p_holm") < alpha,
            "who_is_better": winner(significant, F.col("a12_effective")),
            "conclusion_robust": significant == (F.col("sign_p_holm") < alpha),
        }
    )


__all__ = [
    "a12",
    "compare_methods",
    "holm_adjust",
    "hypothesis_table",
    "paired_values",
    "sign_test",
    "signed_rank_test",
    "signed_ranks",
    "symmetry_statistic",
    "symmetry_test",
    "winner",
]
