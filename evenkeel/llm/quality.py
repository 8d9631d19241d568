"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample. Columns only, no Python rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.columns import BLANKS, let, words_of

SYMBOLS = "#*$%&|<>"
#: The sample that costs and selectivities are measured on; it decides the order of the rules, never a verdict.
SAMPLE_SHARE, SAMPLE_ROWS = 0.1, 1000


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition for rejection from the measures by name."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


#: The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repetition", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("duplicate_lines", lambda m: (m["n_dup_lines"] > 4) & (2 * m["n_dup_lines"] > m["n_lines"])),
)
BASE = 2


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; windows are compared by a 64-bit hash.

    The windows are sorted by hash, those equal to a neighbour are kept, and the union of their three-word reaches is
    counted from the sorted positions: n log n in the words of one document.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(r: Column) -> Column:
            same = lambda p, k: (p["h"] == F.get(r, k - 1)["h"]) | (p["h"] == F.get(r, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(r, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"]))

        def reach(at: Column) -> Column:
            gaps = F.transform(at, lambda v, k: F.coalesce(F.least(v - F.get(at, k - 1), F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(ranked, lambda r: let(positions(r), reach))
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure of a text as a column; ``words`` is the column of its words. A null text has none of anything."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    named = {
        "n_words": F.size(words),
        "word_chars": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)),
        "n_symbols": F.length(F.regexp_replace(whole, "[^" + SYMBOLS + "]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(words),
    }
    return {k: v.cast("long") for k, v in named.items()}


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by rejections per second on a bounded sample of ``docs`` (any order if the sample is empty)."""
    sample = docs.select("text").sample(SAMPLE_SHARE, seed=1).limit(SAMPLE_ROWS).select("text", words_of(F.col("text")).alias("words"))
    sample = sample.persist()
    try:
        total = sample.count()
        named = measures(F.col("text"), F.col("words"))
        score = {}
        for rule in rules:
            began = time.perf_counter()
            hit = sample.agg(F.count_if(rule.rejects(named))).first()[0]
            score[rule.name] = (hit + 0.5) / (total + 1) / (time.perf_counter() - began)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -score[r.name])


def cascade(rules: Sequence[Rule], named: Mapping[str, Column]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    first, *rest = rules
    out = F.when(first.rejects(named), F.lit(first.name))
    for rule in rest:
        out = out.when(rule.rejects(named), F.lit(rule.name))
    return out


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with.

    The words are taken once; each other measure is computed only when the cascade reaches its rule. The verdict is one
    expression, so that a filter moved towards the scan does not take the words again. Null and empty texts have no
    words and are rejected by ``few_words``.
    """
    ordered = order_rules(docs, rules)
    text = docs["text"]
    verdict = let(words_of(text), lambda words: F.coalesce(cascade(ordered, measures(text, words)), F.lit("")))
    return docs.where(verdict == "")


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document the measures, whether a base rule rejects it, and the verdict of the whole cascade."""
    ordered = order_rules(docs, rules)
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    named = measures(F.col("text"), F.col("words"))
    measured = rows.select("doc_id", *[v.alias(k) for k, v in named.items()])
    have = {k: F.col(k) for k in named}
    failed = rules[0].rejects(have)
    for rule in rules[1:BASE]:
        failed = failed | rule.rejects(have)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), cascade(ordered, have).isNull().alias("kept"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS window3
  FROM w WHERE len(ws) >= 3
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window3) AS c FROM g
), p AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR (n_dup_lines > 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM m
"""
