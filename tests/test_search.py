import json

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import arrays
from evenkeel.functions.hashing import hash32, hash60
from evenkeel.operators import search
from evenkeel.plans.grid import EVALUATED, run_grid, sample_evaluator
from evenkeel.roles import Roles, TECHNIQUES
from evenkeel.sources import catalogue, results, scores
from evenkeel.sources.tables import RAW_SCORES, load_dataset

RUN = ["run_id", "population_size", "generations", "alpha", "beta"]


def make_runs(spark, n=6, size=9, generations=2, alpha=0.7, beta=0.6):
    return spark.createDataFrame(
        [(i, size, generations, alpha, beta) for i in range(n)],
        "run_id int, population_size int, generations int, alpha double, beta double",
    )


def toy(df):
    return df.withColumn("fitness", F.size("techniques") + F.col("slot") / 100)


def test_hash_is_the_documented_number(spark):
    assert spark.range(1).select(hash32(42, F.lit(7)).alias("h")).first()["h"] == 1409445407


def test_initial_population(spark):
    rows = search.initial_population(make_runs(spark, 40)).collect()
    assert len(rows) == 360
    for r in rows:
        t = r["techniques"]
        assert 1 <= len(t) <= 8 and len(set(t)) == len(t) and set(t) <= set(TECHNIQUES)
    assert {len(r["techniques"]) for r in rows} == set(range(1, 9))


def test_selection_keeps_the_best_half_in_order(spark):
    df = spark.createDataFrame(
        [(1, 5, 1, ["a"], 0.1), (1, 5, 2, ["b"], float("-inf")), (1, 5, 3, ["c"], 0.9), (1, 5, 4, ["d"], 0.9), (1, 5, 5, ["e"], None),
         (2, 1, 1, ["z"], float("-inf"))],
        "run_id int, population_size int, slot int, techniques array<string>, fitness double",
    )
    out = search.parent_rows(search.select_parents(df, ["run_id", "population_size"])).orderBy("run_id", "rank").collect()
    assert [(r["run_id"], r["techniques"]) for r in out] == [(1, ["c"]), (1, ["d"]), (2, ["z"])]


def cross(spark, a, b, apply, ua, ub):
    arr = lambda x: arrays.name_array(x)
    col = arrays.crossover(arr(a), arr(b), F.lit(apply), F.lit(ua), F.lit(ub))
    return spark.range(1).select(col.alias("c")).first()["c"]


def test_crossover(spark):
    assert cross(spark, ["a", "b", "c"], ["d", "e"], False, 0.9, 0.9) == ["a", "b", "c"]
    assert cross(spark, ["a", "b", "c"], ["d", "e"], True, 0.0, 0.0) == ["a", "e"]
    assert cross(spark, ["a", "b", "c"], ["d", "e"], True, 0.99, 0.99) == ["a", "b", "e"]
    assert cross(spark, ["a"], ["d"], True, 0.5, 0.5) == ["a"]
    assert cross(spark, ["a"], ["d", "e", "f"], True, 0.5, 0.0) == ["a", "e", "f"]


def test_mutation_keeps_length_and_uniqueness(spark):
    def mutate(child, apply, names, up=0.5, un=0.5):
        col = arrays.mutate(arrays.name_array(child), F.lit(apply), F.lit(up), F.lit(un), names)
        return spark.range(1).select(col.alias("c")).first()["c"]

    assert mutate(["a", "b"], False, ["a", "b", "c"]) == ["a", "b"]
    assert mutate(["a", "b"], True, ["a", "b", "c"]) == ["a", "c"]
    assert mutate(["a", "b"], True, ["a", "b"]) == ["a", "b"]
    assert mutate([], True, ["a"]) == []


def test_next_generation_is_valid(spark):
    parents = search.select_parents(toy(search.initial_population(make_runs(spark, 30))), RUN)
    rows = search.breed(parents, 0).collect()
    assert len(rows) == 270 and {r["generation"] for r in rows} == {1}
    for r in rows:
        t = r["techniques"]
        assert t and len(set(t)) == len(t) and set(t) <= set(TECHNIQUES)


def test_without_rates_children_are_copies_of_parents(spark):
    runs = make_runs(spark, 5, alpha=0.0, beta=0.0)
    parents = search.select_parents(toy(search.initial_population(runs)), RUN)
    known = {r["run_id"]: [p["techniques"] for p in r["parents"]] for r in parents.collect()}
    assert all(r["techniques"] in known[r["run_id"]] for r in search.breed(parents, 0).collect())


def test_search_returns_one_valid_answer_per_run(spark):
    out = search.genetic_search(make_runs(spark, 4), toy).collect()
    assert len(out) == 4 and all(r["techniques"] and r["fitness"] > 0 for r in out)


def test_search_rejects_bad_runs(spark):
    with pytest.raises(ValueError):
        search.genetic_search(make_runs(spark, generations=0), toy)
    with pytest.raises(ValueError):
        search.genetic_search(make_runs(spark).withColumn("model", F.lit(None).cast("string")), toy)


# ------------------------------------------------------------------------- score store


def raw(spark, rows):
    cells = [(i, "d", "lr", "sex", "y", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        cells,
        "ord int, dataset string, model string, protected_attribute string, target_column string, techniques string,"
        " fitness string, fairness string, performance string",
    )


def test_store_keeps_order_and_last_row(spark):
    df = raw(spark, [('["a","b"]', "0.1", "", "0.5"), ('["b","a"]', "0.2", "0", "0.5"), ('["a","b"]', "0.3", "inf", "0.6"), ("", "NaN", "", "")])
    got = {tuple(r["techniques"]): (r["fitness"], r["fairness"], r["performance"]) for r in scores.load_scores(df, "ord").collect()}
    assert got == {("a", "b"): (0.3, float("inf"), 0.6), ("b", "a"): (0.2, 0.0, 0.5), (): (float("-inf"), None, None)}


@pytest.mark.parametrize("row", [('["a"]', "abc", "", ""), ("[a", "0.1", "", "")])
def test_corrupt_store_rows_raise(spark, row):
    with pytest.raises(Exception, match="score store"):
        scores.load_scores(raw(spark, [row]), "ord").collect()


def test_lookup_tiers_and_misses(spark):
    runtime = scores.load_scores(raw(spark, [('["a"]', "0.1", "", ""), ('["c"]', "", "", "")]), "ord")
    archive = scores.load_scores(raw(spark, [('["a"]', "0.9", "", ""), ('["b"]', "0.8", "", "")]), "ord")
    asked = raw(spark, [(json.dumps([x]), "", "", "") for x in "abc"]).select(
        "ord", "dataset", "model", "protected_attribute", "target_column", F.from_json("techniques", "array<string>").alias("techniques")
    )

    def got(archive_):
        return [r["fitness"] for r in scores.score_lookup(asked, runtime, archive_, "ord").orderBy("ord").collect()]

    assert got(archive) == [0.1, 0.8, None]
    assert got(None) == [0.1, None, None]
    assert [r["techniques"] for r in scores.score_misses(asked, [runtime, archive]).collect()] == [["c"]]


def test_store_round_trip(spark, tmp_path):
    loaded = scores.load_scores(raw(spark, [('["a","b"]', "NaN", "inf", "0.5"), ('["c"]', "0.25", "", "0.5")]), "ord")
    scores.append_scores(loaded, str(tmp_path / "store"))
    again = scores.load_scores(spark.read.schema("dataset string, model string, protected_attribute string, target_column string,"
        " techniques string, fitness string, fairness string, performance string, timestamp string").parquet(str(tmp_path / "store")), "timestamp")
    key = lambda r: tuple(r[c] for c in ("techniques", "fitness", "fairness", "performance"))
    assert sorted(map(str, map(key, again.collect()))) == sorted(map(str, map(key, loaded.collect())))


def test_single_technique_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, t string")
    out = df.select("id", scores.single_technique(F.col("t")).alias("k")).orderBy("id").collect()
    assert [r["k"] for r in out] == [["a"], [], []]


# ------------------------------------------------------------------ results, catalogue, files


def finished(spark):
    return spark.createDataFrame(
        [("a.csv", "lr", None, 0.5, None), ("a.csv", "rf", "rf", 0.7, "ValueError: x")],
        "dataset string, model_identifier string, model_used string, fitness double, error string",
    )


def test_result_rows_and_recording(spark, tmp_path):
    rows = results.result_rows(finished(spark))
    assert rows.columns == [*results.RESULT_COLUMNS, "error"]
    got = {r["model_identifier"]: r for r in rows.collect()}
    assert got["lr"]["model_used"] == "lr" and got["rf"]["model_used"] is None and got["rf"]["fitness"] is None
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert results.record_results(rows, good, bad) == (1, 1)
    assert results.record_results(rows, good, bad) == (1, 1)
    report = results.validate_output(spark.read.parquet(good), spark.read.parquet(bad)).first()
    assert tuple(report) == (2, 13, 2, True)
    assert results.validate_output(rows.limit(0), rows.limit(0)).first()["ok"] is False


def test_stream_of_results(spark, tmp_path):
    from evenkeel.streaming.recorder import record_stream

    source, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    rows = results.result_rows(finished(spark))
    rows.write.parquet(source)
    for _ in range(2):  # a second start finds nothing new
        record_stream(spark.readStream.schema(rows.schema).parquet(source), good, bad, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(bad).count() == 1


def test_grid_size(spark):
    grid = catalogue.build_tasks(catalogue.catalogue(spark))
    assert grid.count() == 21_600
    assert catalogue.build_tasks(catalogue.catalogue(spark), ["race"], models=["lr"]).count() == 900


def test_csv_with_quotes_and_schema(spark, tmp_path):
    path = tmp_path / "store.csv"
    path.write_text('timestamp,model,protected_attribute,target_column,techniques,fitness,fairness,performance,extra\n'
                    '1.5,lr,sex,y,"[""a"",""b""]",0.5,,0.75,\n')
    df = load_dataset(spark, str(path), RAW_SCORES).withColumn("dataset", F.lit("d"))
    r = scores.load_scores(df, "timestamp").first()
    assert r["techniques"] == ["a", "b"] and r["fitness"] == 0.5 and r["fairness"] is None


def test_load_task_sample(spark, tmp_path):
    folder = tmp_path / "datasets"
    folder.mkdir()
    (folder / "heart.csv").write_text("age,sex,chol,num\n63,1,233,0\n67,1,,2\n41,0,204,1\n")
    out = catalogue.load_task_sample(spark, str(tmp_path), "heart", "sex")
    assert out.columns[-1] == "sex" and sorted(r["num"] for r in out.collect()) == [0.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="race"):
        catalogue.load_task_sample(spark, str(tmp_path), "heart", "race")


def test_run_grid_uses_stored_scores(spark):
    names = [[t] for t in TECHNIQUES]
    store = scores.load_scores(raw(spark, [(json.dumps(n), str(i / 10), "0.1", "0.9") for i, n in enumerate(names)]), "ord")
    runs = make_runs(spark, 3, 40, 1).withColumns(
        {"dataset": F.lit("d"), "model": F.lit("lr"), "protected_attribute": F.lit("sex"), "target_column": F.lit("y")}
    )
    rows = run_grid(runs, store).collect()
    assert len(rows) == 3 and all(r["fitness"] is not None and r["model_used"] == "lr" for r in rows)


def test_run_grid_evaluates_what_no_store_has(spark, tmp_path):
    rows = [(i, float(i % 17), i % 2, i % 60, int(i % 17 + i % 2 * 4 > 9)) for i in range(120)]
    sample = spark.createDataFrame(rows, "row_id long, x double, sex int, age int, target int")
    samples = {("d", a): (sample, Roles("row_id", "target", a)) for a in ("sex", "missing")}
    runs = make_runs(spark, 4, 2, 1).withColumns({
        "dataset": F.lit("d"), "model": F.lit("lr"), "target_column": F.lit("target"),
        "protected_attribute": F.when(F.col("run_id") == 1, "missing").otherwise("sex"),
    })
    empty = spark.createDataFrame([], EVALUATED).drop("error")
    path = str(tmp_path / "store")
    out = {r["protected_attribute"] for r in runs.collect()}
    assert out == {"sex", "missing"}
    done = run_grid(runs, empty, evaluate=sample_evaluator(samples), store_path=path).collect()
    assert len(done) == 4 and all(r["elapsed_seconds"] > 0 for r in done)
    for r in done:
        if r["protected_attribute"] == "missing":
            assert r["error"].split(":")[0] in {"AnalysisException", "ValueError", "KeyError"} and r["fitness"] is None
        else:
            assert r["error"] is None and r["fitness"] is not None and r["techniques"]
    stored = scores.load_scores(spark.read.parquet(path), "timestamp")
    calls = []
    again = run_grid(runs.filter("protected_attribute = 'sex'"), stored, evaluate=lambda m: calls.append(m.count()) or empty.withColumn("error", F.lit(None).cast("string")))
    assert {r["run_id"] if "run_id" in r else r["fitness"] for r in again.collect()} and calls == [0]


def test_scores_of_other_weights_are_not_reused(spark):
    stored = scores.load_scores(raw(spark, [('["a"]', "0.1", "", "")]), "ord")
    asked = spark.createDataFrame(
        [(1, "d", "lr", "sex", "y", ["a"], 0.5, 0.5), (2, "d", "lr", "sex", "y", ["a"], 0.7, 0.3)],
        "ord int, dataset string, model string, protected_attribute string, target_column string, techniques array<string>,"
        " perf_weight double, fair_weight double",
    )
    found = {r["ord"]: r["fitness"] for r in scores.score_lookup(asked, stored, None, "ord").collect()}
    assert found == {1: 0.1, 2: None}
    assert [r["perf_weight"] for r in scores.score_misses(asked, [stored]).collect()] == [0.7]


def test_draws_reach_every_position(spark):
    n = 2**33
    out = spark.range(2000).select(F.pmod(hash60(1, "id"), F.lit(n)).alias("p")).agg(F.max("p"), F.min("p")).first()
    assert out[0] > 2**32 and out[1] < 2**31
