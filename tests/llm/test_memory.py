"""What a worker holds of tables and texts."""

import pickle

import numpy as np
import pyarrow as pa

from evenkeel.llm import phrases
from evenkeel.llm.pretokens import text_parts


def test_a_task_gets_only_the_side_of_a_table_that_it_reads():
    low, high = np.zeros(1 << 20, np.uint8), np.zeros(1 << 20, np.uint8)
    low[5], high[5] = 1, 9
    both = phrases.Counts(low, high)
    assert len(pickle.dumps(both.highs())) < 1.1 * (1 << 20)
    g = np.array([5, 6], np.uint64)
    assert [both.lows().least(g).tolist(), both.highs().most(g).tolist()] == [x.tolist() for x in both.of_keys(g)]


def test_texts_are_taken_from_a_batch_in_parts():
    texts = ["a" * 10, None, "b" * 10, "c" * 50, "", "d"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    parts = [p.column(1).to_pylist() for p in text_parts(batch, 1, 20)]
    assert parts == [["a" * 10, None, "b" * 10], ["c" * 50], ["", "d"]]
    assert list(text_parts(batch.slice(0, 0), 1, 20)) == []
