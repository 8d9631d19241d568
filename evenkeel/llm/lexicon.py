"""Byte-level BPE through a minimal acyclic transducer of frequent words; all other words are merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.pretokens import chunks, distinct, split
from evenkeel.llm.shared import remove, shared_folder
from evenkeel.llm.token_files import LibraryEncoder

#: A word is frequent if it is at least one of so many words of the corpus, so there are at most as many frequent words.
SHARE = 250_000
#: Bytes of the longest word of the lexicon.
LONGEST = 48
#: Merged words that a worker remembers.
REMEMBERED = 500_000
MAGIC = b"EKLEXIC1"
Ids = tuple[int, ...]


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in the tokenizer's file: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """Exact byte-level BPE by the merges of a tokenizer's file, lowest rank first and the leftmost of equals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE")
        letters = _byte_of_letter()
        self.vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        by_name = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[by_name[a], by_name[b]] = (rank, by_name[a + b])
        self.single = [self.vocab.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the vocabulary lacks a byte")

    def merge(self, word: bytes) -> Ids:
        """Ids of one word: a queue of possible merges over a linked list of parts."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs.get
        queue = []
        for i in range(n - 1):
            found = pairs((ids[i], ids[i + 1]))
            if found is not None:
                queue.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = pairs((new, ids[k]))
                if found is not None:
                    heapq.heappush(queue, (found[0], i, found[1], new, ids[k]))
            h = before[i]
            if h >= 0:
                found = pairs((ids[h], new))
                if found is not None:
                    heapq.heappush(queue, (found[0], h, found[1], ids[h], new))
        return tuple([x for x in ids if x >= 0])


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte -> [state, ids]
        self.final: Ids | None = None


def _common(a: Ids, b: Ids) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def build(words: Iterable[tuple[bytes, Ids]]) -> tuple[list[tuple[dict[int, tuple[int, Ids]], Ids | None]], int]:
    """The states of the minimal acyclic transducer of sorted, different words, and its first state.

    Words are added in order; ids move as far to the front as all words through an arc share them. What lies behind the
    common prefix with the next word is final then, and equal states become one, so words share their endings.
    """
    states: list[tuple[dict[int, tuple[int, Ids]], Ids | None]] = []
    known: dict[tuple, int] = {}

    def settle(s: _State) -> int:
        key = (s.final, tuple((b, t, o) for b, (t, o) in s.arcs.items()))
        number = known.get(key)
        if number is None:
            number = known[key] = len(states)
            states.append(({b: (t, o) for b, (t, o) in s.arcs.items()}, s.final))
        return number

    path, last = [_State()], b""
    for word, ids in words:
        if not word:
            raise ValueError("a word of no bytes")
        same = _common(tuple(last), tuple(word))
        for i in range(len(last), same, -1):
            path[i - 1].arcs[last[i - 1]][0] = settle(path.pop())
        for byte in word[same:]:
            path[-1].arcs[byte] = [-1, ()]
            path.append(_State())
        path[-1].final = ()
        rest = ids
        for i in range(same):
            arc = path[i].arcs[word[i]]
            n = _common(arc[1], rest)
            back, arc[1], rest = arc[1][n:], arc[1][:n], rest[n:]
            if back:
                for other in path[i + 1].arcs.values():
                    other[1] = back + other[1]
                if path[i + 1].final is not None:
                    path[i + 1].final = back + path[i + 1].final
        if len(word) == same:
            raise ValueError("words must differ and be sorted")
        path[same].arcs[word[same]][1] = rest
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[last[i - 1]][0] = settle(path.pop())
    return states, settle(path[0])


class Lexicon:
    """A transducer as flat arrays of a file that workers map into memory.

    ``key``: state and byte of every arc, sorted. ``target``: its state. ``out``: the ids that it gives, as a range of
    ``ids``; ``ends``: the ranges of the ids at the end of a word, -1 where no word ends.
    """

    NAMES = ("key", "target", "out", "ends", "ids", "first")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.key, self.target, self.out, self.ends, self.ids, first = (arrays[n] for n in self.NAMES)
        self.first = int(first[0])

    @classmethod
    def of(cls, words: Iterable[tuple[bytes, Ids]]) -> Lexicon:
        states, first = build(words)
        pool: dict[Ids, int] = {}
        flat: list[int] = []

        def place(ids: Ids) -> int:
            """First place and number of the ids, in one number."""
            if ids not in pool:
                pool[ids] = len(flat) << 16 | len(ids)
                flat.extend(ids)
            return pool[ids]

        arcs = sorted((number << 8 | byte, target, place(ids)) for number, (a, _) in enumerate(states) for byte, (target, ids) in a.items())
        ends = [-1 if final is None else place(final) for _, final in states]
        columns = list(zip(*arcs)) or [(), (), ()]
        arrays = [*columns, ends, flat, [first]]
        kinds = (np.int64, np.int32, np.int64, np.int64, np.uint32, np.int64)
        return cls({n: np.array(a, t) for n, a, t in zip(cls.NAMES, arrays, kinds)})

    def save(self, path: str) -> None:
        """Write the arrays, each at a multiple of 64 bytes, behind a table of their places."""
        arrays = [self.key, self.target, self.out, self.ends, self.ids, np.array([self.first])]
        table, at = [], 4096
        for name, a in zip(self.NAMES, arrays):
            table.append((name, a.dtype.str, at, len(a)))
            at += -(-a.nbytes // 64) * 64
        head = json.dumps(table).encode()
        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where.rpartition("/")[0], recursive=True)
        with system.open_output_stream(where) as out:
            out.write(MAGIC + head.ljust(4096 - len(MAGIC)))
            for a in arrays:
                out.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Map a file of :meth:`save`; a file of a store without mapping is read, at the size that SHARE bounds."""
        system, where = fs.FileSystem.from_uri(path)
        if isinstance(system, fs.LocalFileSystem):
            with pa.memory_map(where) as file:
                data = file.read_buffer()
        else:
            with system.open_input_file(where) as file:
                data = file.read_buffer()
        head = data[:4096].to_pybytes()
        if not head.startswith(MAGIC):
            raise ValueError(f"{path} is no lexicon")
        table = json.loads(head[len(MAGIC) :])
        return cls({n: np.frombuffer(data, np.dtype(kind), size, at) for n, kind, at, size in table})

    def look_up(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is in the lexicon, its number of ids, and the ids of all that are, one after another.

        All words walk side by side, one byte a step.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state = np.full(n, self.first, np.int64)
        alive = np.flatnonzero((size > 0) & (size <= LONGEST)) if len(self.key) else np.zeros(0, np.int64)
        ended = np.zeros(n, bool)
        who: list[np.ndarray] = []
        what: list[np.ndarray] = []
        step = 0
        while len(alive):
            key = state[alive] << 8 | data[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            met = self.key[arc] == key
            alive, arc = alive[met], arc[met]
            state[alive] = self.target[arc]
            who.append(alive)
            what.append(self.out[arc])
            step += 1
            more = size[alive] > step
            done = alive[~more]
            end = self.ends[state[done]]
            ended[done[end >= 0]] = True
            who.append(done[end >= 0])
            what.append(end[end >= 0])
            alive = alive[more]
        owner = np.concatenate(who) if who else np.zeros(0, np.int64)
        given = np.concatenate(what) if what else np.zeros(0, np.int64)
        keep = ended[owner] & ((given & 0xFFFF) > 0)
        order = np.argsort(owner[keep], kind="stable")  # steps stay in order
        owner, given = owner[keep][order], given[keep][order]
        number = given & 0xFFFF
        total = np.cumsum(number)
        ids = self.ids[np.repeat((given >> 16) - (total - number), number) + np.arange(total[-1] if len(total) else 0)]
        return ended, np.bincount(owner, number, n).astype(np.int64), ids


@cache
def _merges(path: str) -> Merges:
    return Merges(path)


@cache
def _lexicon(path: str) -> Lexicon:
    return Lexicon.load(path)


class LexiconEncoder(LibraryEncoder):
    """Whole texts by the lexicon, other words by exact merges; texts are cut at added tokens as the library does it."""

    def __init__(self, tokenizer: str, lexicon: str):
        super().__init__(tokenizer)
        self.merges, self.lexicon = _merges(tokenizer), _lexicon(lexicon)

    def _ids(self, pieces: list[bytes]) -> list[Sequence[int]]:
        met, number, ids = self.lexicon.look_up(pieces)
        ends = np.cumsum(number).tolist()
        every = ids.tolist()
        found: list = [every[b - n : b] for b, n in zip(ends, number.tolist())]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i in np.flatnonzero(~met).tolist():
            word = pieces[i]
            known = self.known.get(word)
            if known is None:
                known = self.merges.merge(word)
                if len(word) <= 256:
                    self.known[word] = known
            found[i] = known
        return found


def count_words(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``word`` (binary), ``n``: every word of the ``text`` column as the encoder cuts it, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = LibraryEncoder(tokenizer)
        for batch in batches:
            whole = batch.column(0).to_pylist()
            for a, b in chunks(whole):
                parts = whole[a:b]
                if cutter.find is not None and any(map(cutter.find.search, parts)):
                    parts = [x for t in parts for x in cutter.find.split(t)[::2]]
                data, at, _ = split(parts)
                words, own = distinct(data, at)
                yield pa.record_batch([pa.array(words, pa.binary()), pa.array(np.bincount(own, minlength=len(words)))], ["word", "n"])

    rows = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, share: int = SHARE) -> str:
    """Write the lexicon of the frequent words of all documents to the shared folder; returns its path.

    Words that are at least one in ``share`` of all words and have at most LONGEST bytes are merged by tasks. There are at
    most ``share`` of them, with as many ids as bytes, so the driver may compile them.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "words")
    short = F.when(F.length("word") <= LONGEST, F.col("word")).alias("word")  # of longer ones only the number counts
    count_words(docs, tokenizer).select(short, "n").write.parquet(path)
    table = spark.read.parquet(path)
    total = table.agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([merges.merge(w) for w in words], pa.list_(pa.int32()))], ["word", "ids"])

    frequent = table.where((F.length("word") > 0) & (F.col("n") * share >= total))
    found = frequent.select("word").mapInArrow(run, "word binary, ids array<int>").collect()  # at most ``share``
    remove(spark, path)
    path = shared_folder(spark, "lexicon") + "/words.lexicon"
    Lexicon.of(sorted((bytes(r.word), tuple(r.ids)) for r in found)).save(path)
    return path


def encode_documents(docs: DataFrame, tokenizer: str, share: int = SHARE, ids: bool = False, lexicon: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document.

    Ids are those of the tokenizers library for the whole text without special tokens added; the digests are of the
    decimal ids joined by commas and of the text decoded from the ids, in UTF-8 (bytes that are no UTF-8 become U+FFFD).
    A null text is empty. Repeated rows keep their own results, an empty table gives an empty one, other columns are
    ignored. ``ids`` adds the ids and ``decoded``. ``lexicon``: a file of :func:`compile_lexicon`; otherwise one is made of
    ``docs``. It changes the speed, never a result. The tokenizer's file must lie at its path on every machine.
    """
    path = lexicon or compile_lexicon(docs, tokenizer, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LexiconEncoder(tokenizer, path)
        size = 1 + max(chain(encoder.merges.vocab.values(), encoder.added.values()))
        name, token = [str(i) for i in range(size)], [b""] * size
        for bytes_, i in encoder.merges.vocab.items():
            token[i] = bytes_
        for content, i in encoder.added.items():
            token[i] = content.encode()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                flat, before = encoder.encode(texts[a:b])
                every, cuts = flat.tolist(), before.tolist()
                own = [every[i:j] for i, j in zip(cuts, cuts[1:])]
                decoded = [b"".join([token[i] for i in x]).decode("utf-8", "replace") for x in own]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(",".join([name[i] for i in x]).encode()).hexdigest() for x in own], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(own, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names = [*names, "ids", "decoded"]
                yield pa.record_batch(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
