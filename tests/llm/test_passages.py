"""Repeated strings at their real length, and passages that documents share, against plain versions."""

import re

import pytest

from evenkeel.llm.suffix import PASSAGES, Plan, remove_repeats
from tests.llm.brute import repeats


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def passage_words(docs, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in docs]
    where = {}
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            where.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for (d, _), w in zip(docs, words):
        hit = set()
        for j in range(len(w) - k + 1):
            if len(where[tuple(w[j : j + k])]) > 1:
                hit.update(range(j, j + k))
        out.append((d, len(hit)))
    return sorted(out)


def test_real_lengths_on_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = remove_repeats(df).collect()
    assert {r.doc_id: tuple(r)[:5] for r in got} == repeats(docs, 400)
    assert sorted((r.doc_id, r.n_passage_words) for r in got) == passage_words(docs, 50)


@pytest.mark.parametrize("length, gram", [(12, 4), (5, 2)])
def test_passages_of_other_documents_only(spark, length, gram):
    p = " ".join(f"w{i}" for i in range(length))
    docs = [
        (1, f"a b {p} c"), (2, f"{p.upper()} d e {p}"), (3, "x y " * 60), (4, "y x " * 30 + "z"), (5, f"q {p}"[:-2]), (6, None), (7, ""),
        (8, " ".join(f"v{i % 40}" for i in range(400))), (9, "one " + " ".join(f"u{i}" for i in range(length)) + " two " + " ".join(f"u{i}" for i in range(length))),
        (10, " ".join(f"v{i % 40}" for i in range(7, 30))), (11, "same text " * 9), (11, "same text " * 9),
    ]
    df = spark.createDataFrame([(*d, 5, "k") for d in docs], "doc_id long, text string, n_removed int, spans string")
    plan = Plan(length=length, gram=gram, batches=1, words=True, others=True)
    got = sorted((r.doc_id, r.n_passage_words) for r in remove_repeats(df, Plan(length=40, gram=16), plan).collect())
    assert got == passage_words(docs, length)


def test_long_text_and_empty_table(spark):
    text = "".join(f"{i * i} " for i in range(60000))
    df = spark.createDataFrame([(1, text), (None, text[1000:200000])], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert rows[None].n_removed == 199000 and rows[1].n_removed == 199000 and rows[1].n_spans == 1
    assert rows[1].n_passage_words > 20000
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), passages=PASSAGES).collect() == []
