"""Min-wise tokens by blocks, and the intermediate tables of the near-duplicate join."""

import os

import numpy as np
import pytest

from evenkeel.llm import chosen_path
from evenkeel.llm.shared import Tables


def test_tokens_do_not_depend_on_the_block():
    plan = chosen_path.Plan()
    values = np.unique(np.random.default_rng(5).integers(0, 2**63, 1000, dtype=np.uint64))
    with np.errstate(over="ignore"):
        product = values[:, None] * plan.factors[None, :]
    best = chosen_path.mix((product ^ (product >> np.uint64(32))).min(axis=0))
    assert chosen_path.min_tokens(values, plan)[1] == best.astype("u1").tobytes()
    assert chosen_path.BLOCK_SHINGLES * plan.tokens * 8 <= 1 << 18


@pytest.mark.parametrize("wide", [("tokens", "paths")])
def test_sketches_and_trees_are_deleted_once_they_are_used(spark, tmp_path, monkeypatch, wide):
    made = []
    keep = Tables.written

    def written(self, df, purpose):
        out = keep(self, df, purpose)
        made.append((self.paths[-1].removeprefix("file://"), set(wide) & set(df.columns)))
        return out

    monkeypatch.setattr(Tables, "written", written)
    rows = [(i, " ".join(f"w{(i // 4) * 1000 + j}" for j in range(60))) for i in range(40)]
    done = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in done.collect()} == {(i, i // 4 * 4) for i in range(40)}
    assert any(columns for _, columns in made) and not [path for path, _ in made if os.path.exists(path)]


def test_equal_tokens_are_counted_by_columns():
    """Also where more tokens agree than a byte holds; ``after`` leaves out what was compared before."""
    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, (40, 700)).astype("u1")
    m[7], m[20, :650] = m[3], m[3, :650]
    for after in (False, True):
        found = {i: (hit.tolist(), share.tolist()) for i, hit, share in chosen_path._likely(m, 0.3, after)}
        for i in range(40):
            share = (m == m[i]).mean(axis=1)
            hit = [j for j in range(40) if share[j] >= 0.3 and (j > i or not after)]
            assert found[i] == (hit, share[hit].tolist())
    assert found[3][0] == [7, 20]
