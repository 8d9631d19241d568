"""The evaluation queue of a search: bounded blocks, stored one by one, and a stop in the middle."""

import itertools

import pytest
from pyspark.sql import functions as F

from evenkeel import Roles
from evenkeel.functions.hashing import uniform
from evenkeel.plans import evaluate, grid
from evenkeel.roles import TECHNIQUES
from evenkeel.sources import scores

KEYS = "dataset string, model string, protected_attribute string, target_column string, techniques array<string>, perf_weight double, fair_weight double"


def queue(spark, n):
    lists = itertools.islice(itertools.permutations(TECHNIQUES, 4), n)
    return spark.createDataFrame([("d", "lr", "sex", "y", list(x), 0.5, 0.5) for x in lists], KEYS)


def stub(seen, stop=None):
    def score(block):
        seen.append(block.count())
        if stop is not None and len(seen) > stop:
            raise RuntimeError("stopped")
        text = F.concat_ws(",", "techniques")
        return block.select("*", uniform(1, text).alias("fitness"), F.lit(0.1).alias("fairness"), F.lit(0.9).alias("performance"), F.lit(None).cast("string").alias("error"))

    return score


def test_long_queue_is_planned_in_blocks_and_goes_on_after_a_stop(spark, tmp_path):
    missing, store, seen = queue(spark, 600), str(tmp_path / "store"), []
    with pytest.raises(RuntimeError):
        grid.evaluate_queue(missing, stub(seen, 3), str(tmp_path / "a"), store, size=100)
    done = scores.load_scores(spark.read.parquet(store), "timestamp")
    assert seen == [100] * 4 and done.count() == 300  # the fourth block failed, three are stored
    left, again = grid.missing_scores(missing, [done]), []
    grid.evaluate_queue(left, stub(again), str(tmp_path / "b"), store, size=100)
    assert again == [100] * 3
    both = scores.load_scores(spark.read.parquet(store), "timestamp")
    expected = stub([])(missing).select(F.concat_ws(",", "techniques").alias("t"), "fitness").collect()
    assert sorted(both.select(F.concat_ws(",", "techniques").alias("t"), "fitness").collect()) == sorted(expected)
    assert grid.missing_scores(missing, [both]).count() == 0


def test_blocks_keep_common_beginnings_and_models_together(spark):
    keys = queue(spark, 12).drop("model").crossJoin(spark.createDataFrame([("lr",), ("svc",)], "model string")).select(*scores.SCORE_KEYS)
    got = [[(r.techniques, r.model) for r in b.collect()] for b in grid.blocks(keys, 6)]
    assert [len(b) for b in got] == [6] * 4
    flat = [x for b in got for x in b]
    assert flat == sorted(flat) and all({m for _, m in b} == {"lr", "svc"} for b in got)
    assert [b.count() for b in grid.blocks(keys.limit(0), 6)] == [0]


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.range(160).withColumns({f"f{i}": uniform(i, "id") for i in range(2)})
    df = df.withColumn("sex", (uniform("sex", "id") < 0.5).cast("int"))
    return df.withColumn("target", (F.col("f0") + 0.3 * uniform("e", "id") > 0.65).cast("int")).cache()


def test_block_equals_each_list_alone_and_keeps_failures_apart(spark, sample):
    roles = Roles("id", "target", "sex")
    rows = [
        ("d", "lr", "sex", "target", ["standard"], 0.5, 0.5), ("d", "svc", "sex", "target", ["standard"], 0.5, 0.5),
        ("d", "lr", "sex", "target", ["standard"], 0.9, 0.1), ("d", "lr", "sex", "target", ["standard", "ipw"], 0.5, 0.5),
        ("d", "lr", "sex", "target", [], 0.5, 0.5), ("other", "lr", "sex", "target", [], 0.5, 0.5), ("d", "tree", "sex", "target", [], 0.5, 0.5),
    ]
    got = grid.sample_evaluator({("d", "sex"): (sample, roles)})(spark.createDataFrame(rows, KEYS)).collect()
    assert [tuple(r[:7]) for r in got] == [tuple(r) for r in rows]
    for r in got[:5]:
        alone = evaluate.evaluate_practices(sample, r.techniques, r.model, roles, r.perf_weight, r.fair_weight).first()
        assert r.error is None and tuple(r[7:10]) == pytest.approx(tuple(alone))
    for r in got[5:]:
        assert r.error and r.fitness == float("-inf")
    assert got[5].error.startswith("KeyError") and got[6].error.startswith("ValueError")
