"""Phrase mining against a plain count of everything."""

import re
from collections import Counter, defaultdict

import pytest

from evenkeel.llm import phrases
from evenkeel.llm.phrases import Plan, top_phrases
from tests.llm.brute import lower


def plain(docs, plan):
    count, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= plan.least}
        more = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    more[p[i : i + k]] = max(more[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * more[p] < plan.percent * a:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[: plan.top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("plan", [Plan(least=3, top=40), Plan(least=2, top=5, frontiers=(900_000, 500_000, 100_000, 0))])
def test_equals_a_plain_count(spark, plan):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], plan)
    assert want and rows_of(top_phrases(docs, plan)) == want


def test_nulls_ties_repeats_and_other_columns(spark):
    long = "deep sea. " * 3000
    docs = [(None, "Red Fox, red fox; red\tfox\nred fox jumps! A red fox jumps"), ("en", None), ("en", ""), ("en", "a b\x0bb a. É b É b É b"), ("en", "a b a b a b")] * 2
    docs += [("fr", long), ("", "x y x y x y"), ("und", "red fox jumps"), ("en", "!!! ... ,,,")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, rank int, w1 int")
    plan = Plan(least=3, top=3)
    assert rows_of(top_phrases(df, plan)) == plain(docs, plan)


def test_ties_at_the_last_place_are_settled_by_the_phrase(spark):
    docs = [("en", f"{a}x {a}y.") for a in "hgfedcba"] * 4
    df = spark.createDataFrame(docs, "lang string, text string")
    assert [(r.rank, r.phrase) for r in sorted(top_phrases(df, Plan(least=4, top=3)).collect(), key=lambda r: r.rank)] == [(1, "ax ay"), (2, "bx by"), (3, "cx cy")]


def test_empty_table_and_rare_words(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert top_phrases(none).collect() == []
    few = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert top_phrases(few).collect() == []


def test_bounds_hold_the_counts(spark):
    df = spark.createDataFrame([(i * 7919, n) for i, n in enumerate([1, 2, 3, 30, 31, 1000, 2**20, 2**40])], "w long, n long")
    import numpy as np

    table = phrases.Counts.of(df, ["w"], "n")
    rows = df.collect()
    low, high = table.of_keys(np.array([r.w for r in rows], np.uint64))
    assert all(x <= r.n <= y for x, r, y in zip(low, rows, high))
