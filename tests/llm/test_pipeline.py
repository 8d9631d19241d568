"""The registered queries of the subpackage and the pipeline."""

import hashlib
import os
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from evenkeel.llm import bpe, pii, quality, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_names_follow_the_operators():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = con.sql(queries.SQL[name])
    at = [relation.columns.index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)


def test_pipeline_equals_plain_steps(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    left = {r[0] for r in con.sql(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
    near = brute.near_groups([(d, docs[d].text) for d in left], 5, 80)
    left = {d for d in left if near[d][3]}
    items = con.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    bad = brute.contamination([(d, docs[d].text) for d in left], items)
    left = {d for d in left if not bad[d][5]}
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={}
    )
    clean = {r.doc_id: r.text for r in pii.redact(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == left and 0 < len(left) < len(docs)
    for d, r in got.items():
        spans = brute.base_spans(docs[d].text)
        assert (clean[d] != docs[d].text) == bool(spans)
        assert r.ids == known.encode_ordinary(clean[d]) and r.lang == docs[d].lang and r.n_chars == len(clean[d])
        assert r.decoded_sha256 == hashlib.sha256(clean[d].encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_accept_empty_and_null(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    out = stage(spark, spark.createDataFrame(rows, schema), FOLDER)
    if name != "encoding":
        assert out.columns == schema.names
    out.collect()
