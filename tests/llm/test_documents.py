"""Operators on documents against plain versions: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from evenkeel.llm import bpe, chosen_path, decontaminate, pii, pretokens, quality, shard, suffix, token_files  # noqa: E402

ROWS = "doc_id long, text string"
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


# -- personal data


def pii_rows():
    rng = random.Random(2)
    parts = ["a", "@", ".", "x@y.de", "+", "4", "1", "7086638319846192", "-", " ", "1.2.3.4", "300", "+1 (887) 555-2355", ")", "é", "😀", "%"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for i in range(600)]
    return rows + [(1000, None), (1001, ""), (1002, "1 " * 3000), (1003, "1." * 1500), (1004, "a." * 1200 + "@"), (1005, "a@b.c " * 400)]


def test_pii_base_spans(spark):
    rows = pii_rows()
    got = {r.doc_id: r for r in pii.pii_report(frame(spark, rows)).collect()}
    for d, t in rows:
        base = brute.base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert got[d].n_email == base.count("email:") and got[d].n_card == base.count("card:")


def test_pii_very_long_run_is_linear(spark):
    got = pii.pii_report(frame(spark, [(1, "a" * 300_000), (2, "1" * 300_000), (3, "+1" + " " * 300_000)])).collect()
    assert [r.spans for r in got] == ["", "", ""]


def test_pii_method_adds_checked_spans(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32"), (3, "card 4222222222222 "), (4, "nr 4222222222222 ")]
    got = {r.doc_id: r.spans for r in pii.pii_report(frame(spark, rows)).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "short_card:5:18", 4: ""}


def test_pii_redact_keeps_columns(spark):
    df = frame(spark, [(1, "mail x@y.de now", "k"), (2, None, "l"), (3, "plain", "m")], "doc_id long, text string, rank string")
    assert {tuple(r) for r in pii.redact(df).collect()} == {(1, "mail [EMAIL] now", "k"), (2, None, "l"), (3, "plain", "m")}
    with pytest.raises(ValueError):
        pii.find_spans(df.withColumn("pii_spans", F.lit(1)))


# -- quality


def test_quality_measures_and_verdict(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, None), (3, ""), (4, "a b c " * 30), (5, good.replace("word", "#$word")), (6, "x y\n" * 3 + good), (7, "a b c d a b c")]
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, rows)).collect()}
    assert [got[i].kept for i in range(1, 8)] == [True, False, False, False, False, True, False]
    assert [got[i].base_failed for i in range(1, 8)] == [False, True, True, True, False, False, True]
    assert (got[4].n_words, got[4].word_chars, got[4].n_repeat_words) == (90, 90, 90)
    assert got[7].n_repeat_words == 6 and got[6].n_dup_lines == 2 and got[5].n_symbols == 120
    kept = {r.doc_id for r in quality.filter_documents(frame(spark, rows)).collect()}
    assert kept == {1, 6}


def test_quality_order_prefers_cheap_rejection(spark):
    rows = [(i, "short") for i in range(200)]
    order = quality.order_rules(frame(spark, rows))
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    assert order[-1].name != "few_words"
    assert quality.filter_documents(frame(spark, [])).count() == 0


# -- benchmark passages


def test_decontaminate_equals_brute_force_in_blocks(spark, monkeypatch, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("a b c d e".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(200)] + [(900, None), (901, ""), (902, "A-b c.D")]
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 13, 14, 20]))) for i in range(30)] + [(77, None), (None, "a b c a b c")]
    expected = brute.contamination(docs, items)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for block in (50, 10_000):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        got = decontaminate.contamination_report(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
        assert {r.doc_id: tuple(r) for r in got} == expected
    kept = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, r in expected.items() if not r[5]}
    empty = decontaminate.contamination_report(frame(spark, docs), frame(spark, [], "item_id long, text string"))
    assert empty.where("contaminated or n_hit > 0").count() == 0


# -- near-duplicates


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "one two"), (505, " one  two\n"), (506, "\n")]
    return rows


@pytest.mark.parametrize("k, percent, node", [(3, 85, 2000), (5, 80, 4)])
def test_chosen_path_equals_brute_force(spark, k, percent, node):
    rows = near_rows()
    plan = chosen_path.Plan(shingle=k, percent=percent, node=node, levels=2)
    got = chosen_path.near_duplicates(frame(spark, rows), plan).collect()
    assert {r.doc_id: tuple(r) for r in got} == brute.near_groups(rows, k, percent)


def test_chosen_path_repeats_and_empty(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = frame(spark, [(3, same, 1), (2, same, 2), (2, same, 3), (None, same, 4)], "doc_id long, text string, node int")
    got = sorted(chosen_path.near_duplicates(df).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 2, False), (2, 2, True), (None, 2, False)}
    assert len(got) == 4
    kept = chosen_path.drop_near_duplicates(df, chosen_path.Plan()).collect()
    assert {tuple(r) for r in kept} == {(2, same, 2), (2, same, 3)}
    assert chosen_path.near_duplicates(frame(spark, [])).count() == 0


# -- repeated strings


def test_suffix_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base = [text(60, "abc é") for _ in range(4)]
    rows = [(i, text(rng.randint(0, 10), "xyz") + rng.choice(base)[rng.randint(0, 9) : rng.randint(20, 60)] + text(rng.randint(0, 20), "ab")) for i in range(150)]
    rows += [(400, "a" * 100), (401, None), (402, ""), (403, "ab" * 40)]
    expected = brute.repeats(rows, 20)
    for group in (50_000, 5):
        monkeypatch.setattr(suffix, "MAX_GROUP", group)
        got = suffix.remove_repeats(frame(spark, rows), suffix.Plan(20, 8, 3)).drop("kept", "n_passage_words").collect()
        assert {r.doc_id: tuple(r) for r in got} == expected


def test_suffix_empty_table(spark):
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


# -- tokens


def texts():
    rng = random.Random(5)
    parts = ["a", "b", "e", "t", " ", "  ", "\n", "'s", "'re", "'ll", "'", "1", "23", "é", "ß", "中", "!", "...", "\t", "́", "'S", "the", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "'s", "x" * 3000, "a" * 500]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_prefix_encoding_equals_library():
    v, known = bpe.vocabulary_of(RANKS), reference()
    encoder = pretokens.TextEncoder(lambda pieces: bpe.encode_pieces(v, pieces))
    every = texts()
    ids, before = encoder.encode(every)
    for i, t in enumerate(every):
        own = ids[before[i] : before[i + 1]].tolist()
        assert own == known.encode_ordinary(t)
        assert bpe.decode(v, own) == t.encode()


def test_prefix_encoding_appends_and_edits():
    v, rng = bpe.vocabulary_of(RANKS), random.Random(8)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdefgh the ing") for _ in range(rng.randint(1, 60)))
        table = bpe.PrefixEncoding(v, data[:20])
        table.append(data[20:])
        a = rng.randint(0, len(data))
        b, new = rng.randint(a, len(data)), b"xyz"[: rng.randint(0, 3)]
        table.replace(a, b, new)
        assert table.last == bpe.PrefixEncoding(v, data[:a] + new + data[b:]).last


def test_encode_documents(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (2, "", "z")]
    got = bpe.encode_documents(frame(spark, rows, "doc_id long, text string, piece string"), RANKS, ids=True).collect()
    known = reference().encode_ordinary("hello world")
    first = next(r for r in got if r.doc_id == 1)
    assert first.ids == known and first.ids_sha256 == hashlib.sha256(" ".join(map(str, known)).encode()).hexdigest()
    assert first.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert [r.n_tokens for r in got if r.doc_id == 2] == [0, 0] and {r.piece for r in got} == {"x", "y", "z"}
    with pytest.raises(ValueError):
        bpe.encode_documents(frame(spark, rows, "doc_id long, text string, n_tokens string"), RANKS)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(3, None), (1, ""), (2, "hi there " * 700), (5, "x"), (4, "été 'll go")] + [(10 + i, t) for i, t in enumerate(texts()[:200])]
    files = token_files.write_token_files(frame(spark, rows), TOKENIZER, f"file://{tmp_path}/out", length=16)
    got = sorted(token_files.read_token_files(files, token_files.ids_crc32, "ids_crc32 long").collect())
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for (d, t), r in zip(sorted(rows), got, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    ids, mask, _ = next(token_files.StreamReader(files.first().path).batches())
    assert ids.shape[1] == 16 and ids.shape == mask.shape
    assert token_files.token_round_trip(spark, frame(spark, []), TOKENIZER).count() == 0


def test_token_files_added_tokens_and_access_by_number(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    end, tokenizer = "<|endoftext|>", Tokenizer.from_file(TOKENIZER)
    rows = [(1, f"a {end} b"), (2, end), (3, end + end + " x"), (4, "plain"), (5, f"tail{end}"), (6, "<|endoftext|"), (7, "")]
    rows += [(20 + i, t.replace("!", end)) for i, t in enumerate(texts()[:100])]
    encoder = token_files.piece_encoder(TOKENIZER)
    for plain in (True, False):
        encoder.plain = plain
        ids, before = encoder.encode([t for _, t in rows])
        for i, (_, t) in enumerate(rows):
            assert ids[before[i] : before[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    files = token_files.write_token_files(frame(spark, rows), TOKENIZER, f"file://{tmp_path}/out", length=16)
    got = {r.doc_id: r.n_tokens for r in token_files.read_token_files(files, token_files.ids_crc32, "ids_crc32 long").collect()}
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}

    monkeypatch.setattr(token_files, "BATCH", 4)
    path = f"file://{tmp_path}/own/part.arrow"
    writer = token_files.StreamWriter(path, 8, np.dtype(np.uint16), 0)
    for n in (3, 100, 0, 9, 70):
        writer.add(n, np.arange(n))
    writer.close()
    every = [(i, m) for ids, mask, _ in token_files.StreamReader(path).batches() for i, m in zip(ids.tolist(), mask.tolist())]
    reader = token_files.StreamReader(path)
    assert len(reader) == len(every) > 8
    for i in reversed(range(len(every))):
        ids, mask = reader.sequence(i)
        assert (ids.tolist(), mask.tolist()) == every[i]
    with pytest.raises(IndexError):
        reader.sequence(len(every))


# -- shards


def test_shard_matrix_is_exact():
    counts = [5, 0, 17, 100, 1]
    m = shard.draw_matrix(counts, 7, 3)
    assert m.sum(axis=1).tolist() == counts and sorted(m.sum(axis=0).tolist()) == [17] * 4 + [18] * 2 + [19] or m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_shard_draw_keeps_its_law_on_large_input():
    rng = np.random.default_rng(1)
    ones = sum(shard._hypergeometric(rng, 1, 2_000_000_000, 20_000_000) for _ in range(20_000))
    assert 130 < ones < 270  # 200 expected
    few = np.array([shard._inverted(rng, 5, 7, 6) for _ in range(20_000)])
    assert np.abs(np.bincount(few, minlength=6) / 20_000 - np.array([7, 105, 350, 350, 105, 7]) / 924).max() < 0.015
    assert sum(draw_row := shard.draw_matrix([3_000_000_000, 10**6], 24, 5)[1].tolist()) == 10**6 and min(draw_row) > 40_000


def test_shard_sizes_slots_and_repeats(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(500)] + [(None, None), (7, ""), (7, "")]
    got = shard.shard_documents(frame(spark, rows), shards=24).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    none = next(r for r in got if r.doc_id is None)
    assert (none.size, none.text_crc32, none.law, none.grown_shard) == (8, 0, "rows", None)
    assert shard.shard_documents(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        shard.uniform_shards(frame(spark, rows).withColumn("shard", F.lit(1)), [F.col("doc_id")])


def test_shard_order_is_near_uniform(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = shard.shard_documents(df, shards=6).collect()
    first = [r.doc_id for r in got if r.slot < 100]
    assert abs(np.mean(first) - 3000) < 300
    neighbours = sum(1 for s in range(6) for a, b in [(r.doc_id, r.slot) for r in got if r.shard == s and r.doc_id == r.slot] if a == b)
    assert neighbours < 40
