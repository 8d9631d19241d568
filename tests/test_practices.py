from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel import Roles
from evenkeel.operators import mitigation, practices

ROLES = Roles("id", "y", "g")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 7), 5.0, i % 2, "a" if i % 3 else ("b" if i % 2 else "c")) for i in range(120)]
    return spark.createDataFrame(rows, "id int, x double, k double, y int, g string").cache()


def sizes(df):
    return Counter(r["g"] for r in df.collect())


def test_standard_scales_target_and_moves_protected_last(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 4.0, 0), (2, 0, 4.0, 4.0, 1)], "id int, g int, x double, k double, y int")
    out = practices.standard(df, ROLES)
    assert out.columns == ["id", "x", "k", "y", "g"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, -1.0, 0.0, -1.0, 1), (2, 1.0, 0.0, 1.0, 0)]
    kept = practices.standard(df, ROLES, exclude=("y",))
    assert [r["y"] for r in kept.orderBy("id").collect()] == [0, 1]


def test_min_max_scales_protected_too(spark):
    df = spark.createDataFrame([(1, 10, 2.0, 7.0), (2, 20, None, 7.0), (3, 30, 4.0, 7.0)], "id int, g int, x double, k double")
    got = [tuple(r) for r in practices.min_max_scaling(df, ROLES).orderBy("id").collect()]
    assert got == [(1, 0.0, 0.0, 0.0), (2, 0.5, None, 0.0), (3, 1.0, 1.0, 0.0)]


def test_samplers_equalise_groups(table):
    before = sizes(table)
    low, high = min(before.values()), max(before.values())
    for f in (practices.stratified_sampling, practices.undersampling):
        out = f(table, ROLES)
        assert set(sizes(out).values()) == {low}
        assert out.select("id").distinct().count() == out.count()
    up = practices.oversampling(table, ROLES)
    assert sizes(up) == {g: high for g in before}
    assert up.select("id").distinct().count() == up.count()
    source = {str(r["id"]): r["g"] for r in table.collect()}
    assert all(source[r["id"].split("#")[0]] == r["g"] for r in up.collect())


def test_null_groups_and_missing_columns(spark, table):
    holes = table.withColumn("g", F.when(F.col("g") != "b", F.col("g")))
    assert set(sizes(practices.stratified_sampling(holes, ROLES))) == {"a", "c"}
    for f in (practices.oversampling, practices.undersampling, practices.ipw):
        with pytest.raises(ValueError):
            f(holes, ROLES)
        with pytest.raises(ValueError):
            f(table.drop("g"), ROLES)
    assert practices.stratified_sampling(table.drop("g"), ROLES).count() == 0


def test_ipw(table):
    n = sizes(table)
    for r in practices.ipw(table, ROLES).collect():
        assert r["Weight"] == pytest.approx(120 / n[r["g"]])


def test_clustering_appends_an_integer(table):
    out = practices.clustering(table, ROLES)
    assert dict(out.dtypes)["Cluster"] == "int" and out.count() == 120


def test_unknown_practice_and_single_name(table):
    assert practices.apply_practices(table, "nothing", ROLES) is table
    assert practices.apply_practices(table, None, ROLES) is table
    assert "Weight" in practices.apply_practices(table, "ipw", ROLES).columns


def test_quadrants_are_filled(spark):
    y = [0, 0, 0, 0, 0, 0, 1, 1, 0, 1]
    s = [0, 0, 0, 0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(y, s))], "id int, f int, y int, s int")
    out = mitigation.quadrant_oversample(df, "y", "s", "id").collect()
    assert Counter((r["y"], r["s"]) for r in out) == {(0, 0): 4, (0, 1): 4, (1, 0): 4, (1, 1): 4}
    assert {str(i) for i in range(10)} <= {r["id"] for r in out}
    with pytest.raises(ValueError):
        mitigation.quadrant_oversample(df.withColumn("y", F.col("id") % 3), "y", "s", "id")


def test_group_binarisation(spark):
    df = spark.createDataFrame([(1, 20, 0), (2, 30, 1), (3, 40, 1), (4, 70, 1)], "id int, age int, sex int")
    for column, expected in (("age", [0, 0, 0, 1]), ("sex", [0, 1, 1, 1])):
        out = mitigation.binarize_group(df, column).orderBy("id").collect()
        assert [r["s"] for r in out] == expected


def test_reweighing_makes_label_and_group_independent(spark):
    df = spark.createDataFrame(
        [(i, int(i % 5 < 3), int(i % 3 == 0)) for i in range(60)] + [(99, 1, 7)], "id int, y int, s int"
    )
    out = mitigation.reweigh(df, "y", "s", "id").collect()
    mass = Counter()
    for r in out:
        mass[(r["y"], r["s"])] += r["weight"]
    assert mass[(1, 0)] * mass[(0, 1)] == pytest.approx(mass[(1, 1)] * mass[(0, 0)])
    assert next(r["weight"] for r in out if r["id"] == 99) == 1.0


def brute_repair(rows):
    """(group, value) -> repaired value by the definition, on plain lists."""
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for vs in groups.values():
        vs.sort()
    b = min(len(vs) for vs in groups.values())

    def median(vs):
        vs = sorted(vs)
        m = len(vs) // 2
        return vs[m] if len(vs) % 2 else (vs[m - 1] + vs[m]) / 2

    target = [median([vs[q * len(vs) // b] for vs in groups.values()]) for q in range(b)]
    return {(g, v): target[vs.index(v) * b // len(vs)] for g, vs in groups.items() for v in vs}


def test_repair_matches_definition(spark):
    rows = [("abc"[i % 5 % 3], float((i * 37) % 23)) for i in range(80)]
    df = spark.createDataFrame([(i, g, v, 1.0) for i, (g, v) in enumerate(rows)], "id int, g string, v double, y double")
    expected = brute_repair(rows)
    for r in mitigation.repair_features(df, ROLES, ["v"]).collect():
        assert r["v"] == expected[rows[r["id"]]]


def test_dispatch(spark, table):
    plain, weight = mitigation.mitigate(table, "unknown", ROLES)
    assert plain is table and weight is None
    numbers = table.withColumn("g", (F.col("g") == "a").cast("int"))
    assert mitigation.mitigate(numbers, "ReWeighing", ROLES)[1] == "weight"
