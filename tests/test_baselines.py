"""Paired comparisons take every baseline, also in their SQL."""

import os

import duckdb
import pytest

from evenkeel import registry
from evenkeel.bindings.statistics import PAIRED

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.mark.parametrize("name", [f.__name__ for f in PAIRED])
def test_every_baseline_is_compared(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    queries, sql = registry.queries(), registry.oracle_sql()
    assert queries[f"{name}_all"] is queries[name] and sql[f"{name}_all"] == sql[name]
    df = queries[name](spark, FOLDER)
    columns = df.columns
    ours = df.collect()
    assert {r.baseline for r in ours} == {"2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"}
    theirs = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql[name]})").fetchall()
    clean = lambda v: v + 0.0 if isinstance(v, float) else v
    assert sorted((tuple(map(clean, r)) for r in ours), key=repr) == sorted((tuple(map(clean, r)) for r in theirs), key=repr)
