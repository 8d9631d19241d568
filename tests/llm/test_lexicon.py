"""The transducer against the words it is made of and the tokenizers library."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from evenkeel.llm import lexicon
from evenkeel.llm.lexicon import Lexicon, Merges, build

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_transducer_gives_the_ids_of_its_words_and_only_those(tmp_path):
    rnd = random.Random(3)
    words = {bytes(rnd.choices(b"abcd", k=rnd.randint(1, 7))): tuple(rnd.choices(range(5), k=rnd.randint(0, 4))) for _ in range(600)}
    file = f"file://{tmp_path}/sub/x.lexicon"
    Lexicon.of(sorted(words.items())).save(file)
    found = Lexicon.load(file)
    asked = [*words, b"", b"zz", b"abcdabcdabcd", *[bytes(rnd.choices(b"abcd", k=5)) for _ in range(300)]]
    met, number, ids = found.look_up(asked)
    at = 0
    for w, m, n in zip(asked, met.tolist(), number.tolist()):
        assert m == (w in words)
        assert tuple(ids[at : at + n].tolist()) == words.get(w, ())
        at += n


def test_transducer_is_minimal():
    states, first = build([(b + e, (len(b), 7)) for b, e in sorted((b, e) for b in (b"a", b"b", b"c") for e in (b"ing", b"ings"))])
    assert len(states) == len(set(map(repr, states)))
    assert len(states) == 6  # start, then i, n, g, s shared by all words, and their end
    assert build([])[0][build([])[1]] == ({}, None)


def test_empty_lexicon():
    met, number, ids = Lexicon.of([]).look_up([b"a", b""])
    assert not met.any() and not number.any() and not len(ids)


def test_merges_equal_the_library():
    library, merges, rnd = Tokenizer.from_file(PATH), Merges(PATH), random.Random(5)
    for word in ["a", "hello", "x" * 3000, "abcab" * 900, "straße", "日本語日本語", "".join(rnd.choices("aeinrst", k=400))]:
        assert list(merges.merge(word.encode())) == library.encode(word, add_special_tokens=False).ids


def test_documents_equal_the_library(spark):
    texts = [None, "", " ", "a <|endoftext|> b<|endoftext|>", "don't  stop\n\n", "é𝒳\x00 12345 ½", "word " * 20000, "x" * 30000, "same", "same"]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(9, "same", 1, "k"), (None, "no id", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is not None, r)
    for share in (1, 10, lexicon.SHARE):  # no word, some words and all words in the lexicon
        got = [tuple(r) for r in lexicon.encode_documents(df, PATH, share).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    full = {r.doc_id: r for r in lexicon.encode_documents(df.where("doc_id < 9"), PATH, ids=True).collect()}
    assert full[3].decoded == texts[3] and full[4].ids == library.encode(texts[4], add_special_tokens=False).ids


def test_empty_table(spark):
    assert lexicon.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
