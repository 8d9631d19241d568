"""One-hot encoding without a cap."""

from evenkeel.operators import clean
from evenkeel.plans import evaluate


def test_columns_over_the_limit_become_one_sparse_vector(spark):
    rows = [(i, f"v{i % 30:02d}" if i % 7 else None, "ab"[i % 2], f"w{i % 11:02d}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, t int")
    got = clean.one_hot(df, ["a", "b", "c"], limit=5)
    assert got.columns == ["id", "t", "b_b", "encoded"]
    by = {r.id: r.encoded for r in got.collect()}
    names = [("a", v) for v in sorted({r[1] for r in rows if r[1]})[1:]] + [("c", v) for v in sorted({r[3] for r in rows})[1:]]
    for i, a, _, c, _ in rows:
        assert by[i].toArray().tolist() == [float(v == {"a": a, "c": c}[n]) for n, v in names]
    assert len(by) == got.count() == 200
    ready = clean.prepare_model(df, "t", "id", limit=5)
    features = evaluate.feature_columns(ready, "id", "t")
    assert evaluate.assemble(ready, features).first().features.size == 1 + len(names)
