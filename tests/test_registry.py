"""Registered queries against their checking SQL on the smallest tables, where these exist."""

import os

import duckdb
import pytest

from evenkeel import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events lineitem nation orders pages part region supplier labels".split()
CHECKED = [
    "fairness_report", "pr_auc", "priv_mode", "one_hot", "prepare_model", "stratified_sample", "oversample",
    "practices_subset", "quadrant_oversample", "reweigh", "repair_ties", "summary_grouping_sets", "tied_best",
    "delta_flags", "box_stats", "a12_events", "wilcoxon_p", "holm_adjust", "score_lookup", "ga_search",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {
        "kmeans_cluster", "train_lr", "train_rf", "train_svc", "train_gbt", "cv_predict", "evaluate_practices",
        "evaluate_baseline", "static_baselines", "method_results",
    }


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = con.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    clean = lambda v: v + 0.0 if isinstance(v, float) else v
    ours = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(clean(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
