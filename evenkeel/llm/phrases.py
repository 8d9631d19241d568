"""Phrases whose words belong together, by best-first growth of prefixes under bounds of their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.llm.pretokens import text_parts
from evenkeel.llm.shared import written
from evenkeel.llm.textwords import U, Words, byte_set, mix

#: Characters of text handled at once, unless one text alone is longer.
CHUNK_CHARS = 750_000
#: Slots of a table of counts; with more keys, its bounds only become looser.
MAX_SLOTS = 1 << 24
#: Phrases that a task remembers to have sent.
MAX_SENT = 100_000
#: Scores down to which the frontier is expanded at once; 0 expands all of it.
FRONTIERS = (200_000, 0)
_BREAKS = byte_set([(0x0A, 0x0D)])
for _c in b".,;:!?":
    _BREAKS[_c] = 1
_IN_WORD = 1 - np.maximum(_BREAKS, byte_set([(0x09, 0x09), (0x20, 0x20)]))
_STEPS = 4


@dataclass(frozen=True)
class Plan:
    """``least``: occurrences of a candidate. ``top``: phrases of each language. ``percent``: a phrase is dropped for a longer
    one that is found at least so often. ``frontiers``: falling bounds of rounds."""

    least: int = 30
    top: int = 2000
    percent: int = 80
    frontiers: tuple[int, ...] = FRONTIERS


def _join(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases from those of their prefixes and of their last words."""
    with np.errstate(over="ignore"):
        return mix(left * U(0x9E3779B97F4A7C15) + word)


class Chunk:
    """Words of some texts: ``w`` (64-bit hashes of language and word) and which starts have k words in one piece."""

    def __init__(self, langs: list[str], texts: list[str | None]):
        import xxhash

        self.words = words = Words(texts, _IN_WORD)
        n = len(words)
        prints = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
        seed = np.array([prints[x] for x in langs], U)
        self.text = words.text_of() if n else np.zeros(0, np.int64)
        self.w = mix(words.hashes ^ seed[self.text]) if n else np.zeros(0, U)
        data = np.frombuffer(words.data, np.uint8)
        breaks = np.concatenate(([0], np.cumsum(_BREAKS[data], dtype=np.int64)))
        self.linked = np.zeros(n, bool)  # the next word belongs to the same piece
        if n:
            self.linked[:-1] = breaks[words.starts[1:]] == breaks[words.stops[:-1]]

    def starts(self, k: int) -> np.ndarray:
        """Words that begin a phrase of k words."""
        n = max(0, len(self.w) - k + 1)
        ok = np.ones(n, bool)
        for i in range(k - 1):
            ok &= self.linked[i : i + n]
        return np.flatnonzero(ok)

    def prints(self, k: int) -> np.ndarray:
        """Fingerprint of the k words from each word on, whether or not they are one phrase."""
        g = self.w
        for i in range(1, k):
            g = _join(g[:-1], self.w[i:])
        return g


class Counts:
    """Upper and lower bounds of the counts of keys, by slots of a table; a key that was not put in may be met, too.

    Tasks are sent only the side that they ask for (``lows``, ``highs``): every worker holds its own copy.
    """

    def __init__(self, low: np.ndarray | None, high: np.ndarray | None):
        self.low, self.high = low, high
        scale = 2.0 ** (np.arange(257) / _STEPS)
        self.floor = np.concatenate(([0.0], scale[:255] * (1 - 1e-9)))  # a slot holds the step plus 1, or 0
        self.ceil = np.concatenate(([0.0], scale[1:256] * (1 + 1e-9)))

    @staticmethod
    def of(table: DataFrame, keys: list[str], count: str) -> Counts:
        """From a table of different keys; ``keys`` are the words of a phrase."""
        slots = min(MAX_SLOTS, 1 << max(20, (int(table.count()) * 32).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *parts, n = [c.to_numpy() for c in batch.columns]
                g = reduce(_join, [p.view(U) for p in parts])
                step = 1 + np.floor(np.log2(np.maximum(n, 1).astype(float)) * _STEPS).astype(np.int16)
                yield pa.record_batch([pa.array((g & U(slots - 1)).astype(np.int32)), pa.array(step)], ["slot", "step"])

        each = table.select(*keys, F.col(count).cast("long")).mapInArrow(run, "slot int, step short").groupBy("slot")
        found = each.agg(F.min("step").alias("low"), F.max("step").alias("high")).toArrow()  # MAX_SLOTS rows of 8 bytes at most
        low, high = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
        at = found.column("slot").to_numpy()
        low[at], high[at] = found.column("low").to_numpy(), found.column("high").to_numpy()
        return Counts(low, high)

    def lows(self) -> Counts:
        return Counts(self.low, None)

    def highs(self) -> Counts:
        return Counts(None, self.high)

    def least(self, g: np.ndarray) -> np.ndarray:
        """Least count of each key; 0 for keys that surely are not in the table."""
        return self.floor[self.low[(g & U(len(self.low) - 1)).astype(np.int64)]]

    def most(self, g: np.ndarray) -> np.ndarray:
        """Greatest count of each key; 0 for keys that surely are not in the table."""
        return self.ceil[self.high[(g & U(len(self.high) - 1)).astype(np.int64)]]

    def of_keys(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest count of each key."""
        return self.least(g), self.most(g)


def _sums(chunk: Chunk, at: np.ndarray, g: np.ndarray, k: int, kind: int | None = None) -> list[pa.Array]:
    """Words of the different phrases of k words among those that start at ``at``, and how often they are there."""
    _, first, n = np.unique(g, return_index=True, return_counts=True)
    at = at[first]
    words = [pa.array(chunk.w[at + i].view(np.int64)) for i in range(k)]
    if kind is None:
        return [*words, pa.array(n.astype(np.int64))]
    return [pa.array(np.full(len(at), kind, np.int8)), *words, *[pa.nulls(len(at), pa.int64())] * (4 - k), pa.array(n.astype(np.int64))]


def _scan(docs: DataFrame, body: Callable[..., Iterator[list[pa.Array]]], schema: str, *tables: Counts) -> DataFrame:
    """Rows that ``body(chunk, langs, *tables)`` makes of each chunk of texts; no text leaves its task.

    ``tables`` are broadcast, so that a worker holds them once and not a second time inside the pickled function.
    """
    names = [part.split()[0] for part in schema.split(",")]
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 1, CHUNK_CHARS):
                langs = part.column(0).to_pylist()
                for columns in body(Chunk(langs, part.column(1).to_pylist()), langs, *shared.value):
                    yield pa.record_batch(columns, names)

    return docs.select("lang", "text").mapInArrow(run, schema)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, w, n`` of every word, and the number of all words of a language in the row without a word."""

    def body(chunk: Chunk, langs: list[str]) -> Iterator[list[pa.Array]]:
        if not len(chunk.w):
            return
        w, first, n = np.unique(chunk.w, return_index=True, return_counts=True)
        of = np.array(langs, object)[chunk.text[first]]
        yield [pa.array(of, pa.string()), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))]
        all_langs, total = np.unique(np.array(langs, object)[chunk.text].astype(str), return_counts=True)
        yield [pa.array(all_langs.tolist(), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(total.astype(np.int64))]

    return _scan(docs, body, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)), exact: a decimal product and an integral division."""
    return F.expr(f"(cast(2000000 as decimal(7,0)) * cast({a} as decimal(20,0))) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")


def _grown(docs: DataFrame, k: int, prefixes: Counts, words: Counts, bound: float, least: int) -> DataFrame:
    """``w1 .. wk, a``: phrases of k words that extend a prefix of the frontier, may score ``bound`` and are found often.

    A phrase cannot be more frequent than its prefix and its last word, and every longer phrase that begins with it has the
    first word as a left part, so a / (f(w1) + a) bounds them all.
    """

    def body(chunk: Chunk, langs: list[str], prefixes: Counts, words: Counts) -> Iterator[list[pa.Array]]:
        at = chunk.starts(k)
        low_first = words.least(chunk.w[at])
        most = np.minimum(prefixes.most(chunk.prints(k - 1)[at]), words.most(chunk.w[at + k - 1]))
        ok = (most >= least) & (low_first > 0) & (2e6 * most >= bound * (1 - 1e-9) * (low_first + most))
        at = at[ok]
        if len(at):
            yield _sums(chunk, at, chunk.prints(k)[at], k)

    names = [f"w{i + 1}" for i in range(k)]
    found = _scan(docs, body, ", ".join([f"{n} long" for n in names] + ["a long"]), prefixes.highs(), words)
    return found.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


_ANY = "kind byte, w1 long, w2 long, w3 long, w4 long, n long"
_KEYS = ["w1", "w2", "w3", "w4"]
#: Kinds of rows of the last count: wanted pairs and triples, and candidates of two and three words grown to either side.
PAIR, TRIPLE, PAIR_LEFT, PAIR_RIGHT, TRIPLE_LEFT, TRIPLE_RIGHT = range(6)


def _looked_up(docs: DataFrame, pairs: Counts, triples: Counts, grown: dict[int, Counts], words: Counts, plan: Plan) -> DataFrame:
    """``kind, w1 .. w4, n``: counts of wanted parts, and of candidates with one more word that is frequent enough to matter."""

    def body(chunk: Chunk, langs: list[str], pairs: Counts, triples: Counts, two: Counts, three: Counts, words: Counts) -> Iterator[list[pa.Array]]:
        for kind, k, wanted in ((PAIR, 2, pairs), (TRIPLE, 3, triples)):
            at = chunk.starts(k)
            at = at[wanted.most(chunk.prints(k)[at]) > 0]
            if len(at):
                yield _sums(chunk, at, chunk.prints(k)[at], k, kind)
        for k, grown, left, right in ((2, two, PAIR_LEFT, PAIR_RIGHT), (3, three, TRIPLE_LEFT, TRIPLE_RIGHT)):
            at = chunk.starts(k + 1)
            inner, whole = chunk.prints(k), chunk.prints(k + 1)
            for kind, shift, extra in ((left, 1, 0), (right, 0, k)):
                low = grown.least(inner[at + shift])
                ok = (low > 0) & (100 * words.most(chunk.w[at + extra]) >= plan.percent * low)
                if ok.any():
                    yield _sums(chunk, at[ok], whole[at[ok]], k + 1, kind)

    tables = pairs.highs(), triples.highs(), grown[2].lows(), grown[3].lows(), words.highs()
    found = _scan(docs, body, _ANY, *tables).groupBy("kind", *_KEYS).agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= plan.least)  # a part is as frequent as its candidate at least


def _texts(docs: DataFrame, wanted: dict[int, Counts]) -> DataFrame:
    """``w1 .. w4, phrase``: the texts of the wanted phrases, once a task or so."""

    def body(chunk: Chunk, tables: tuple[Counts, ...], sent: set) -> Iterator[list[pa.Array]]:
        for k, table in zip(sizes, tables):
            at = chunk.starts(k)
            g = chunk.prints(k)[at] if len(at) else np.zeros(0, U)
            at = at[hit := table.most(g) > 0]
            g, first = np.unique(g[hit], return_index=True)
            new = [i for i, x in zip(first.tolist(), g.tolist()) if (k, x) not in sent]
            sent.update((k, x) for x in g.tolist())
            if len(sent) > MAX_SENT:
                sent.clear()
            at = at[new]
            if len(at):
                phrases = [chunk.words.joined(i, i + k).decode() for i in at.tolist()]
                words = [pa.array(chunk.w[at + i].view(np.int64)) for i in range(k)]
                yield [*words, *[pa.nulls(len(at), pa.int64())] * (4 - k), pa.array(phrases, pa.string())]

    def each() -> Callable[..., Iterator[list[pa.Array]]]:
        sent: set = set()
        return lambda chunk, langs, *tables: body(chunk, tables, sent)

    sizes, tables = tuple(wanted), [t.highs() for t in wanted.values()]
    found = _scan(docs, each(), "w1 long, w2 long, w3 long, w4 long, phrase string", *tables)
    return found.groupBy(*_KEYS).agg(F.min("phrase").alias("phrase"))


def _round(docs: DataFrame, words: DataFrame, table: Counts, bound: int, plan: Plan) -> DataFrame:
    """``lang, w1 .. w4, a, l, r, score`` of all phrases of at least ``bound`` that are not dropped."""
    first = words.select(F.col("w").alias("w1"), "lang", F.col("n").alias("f1"))

    def last(k: int) -> DataFrame:
        return words.select(F.col("w").alias(f"w{k}"), F.col("n").alias(f"f{k}"))

    may = F.expr("(cast(2000000 as decimal(7,0)) * a) div (cast(f1 as decimal(20,0)) + a)") >= bound
    two = _grown(docs, 2, table, table, bound, plan.least).join(first, "w1").join(last(2), "w2")
    two = written(two.where(may).withColumn("score", _score("a", "f1", "f2")), "pairs")
    three = _grown(docs, 3, Counts.of(two, ["w1", "w2"], "a"), table, bound, plan.least)
    three = three.join(two.select("w1", "w2", "lang", "f1", F.col("a").alias("f12")), ["w1", "w2"]).join(last(3), "w3")
    three = written(three.where(may).withColumn("s2", _score("a", "f12", "f3")), "triples")
    four = _grown(docs, 4, Counts.of(three, ["w1", "w2", "w3"], "a"), table, bound, plan.least)
    four = four.join(three.select("w1", "w2", "w3", "lang", "f1", "f12", F.col("a").alias("f123")), ["w1", "w2", "w3"]).join(last(4), "w4")
    four = four.where(may).withColumn("s3", _score("a", "f123", "f4")).where(F.col("s3") >= bound)
    four = written(four.where(_score("a", "f12", "a") >= bound), "quads")

    two, three = two.where(F.col("score") >= bound), three.where(F.col("s2") >= bound)
    part = lambda df, *c: df.select(*[F.col(x).alias(f"w{i + 1}") for i, x in enumerate(c)], F.lit(1).alias("n"))
    pairs = written(part(three, "w2", "w3").unionByName(part(four, "w3", "w4")).distinct(), "wanted-pairs")
    triples = written(part(four, "w2", "w3", "w4").distinct(), "wanted-triples")
    grown = {2: Counts.of(two, ["w1", "w2"], "a"), 3: Counts.of(three, ["w1", "w2", "w3"], "a")}
    found = written(
        _looked_up(docs, Counts.of(pairs, ["w1", "w2"], "n"), Counts.of(triples, ["w1", "w2", "w3"], "n"), grown, table, plan), "looked-up"
    )
    right = lambda kind, n, *c: found.where(F.col("kind") == kind).select(*[F.col(f"w{i + 1}").alias(x) for i, x in enumerate(c)], F.col("n").alias(n))
    three = three.join(right(PAIR, "f23", "w2", "w3"), ["w2", "w3"]).withColumn("s1", _score("a", "f1", "f23"))
    four = four.join(right(PAIR, "f34", "w3", "w4"), ["w3", "w4"]).join(right(TRIPLE, "f234", "w2", "w3", "w4"), ["w2", "w3", "w4"])
    four = four.withColumn("s1", _score("a", "f1", "f234")).withColumn("s2", _score("a", "f12", "f34"))

    def longer(k: int) -> DataFrame:
        """The greatest count of a candidate of k words with one more word at either side."""
        kinds = (PAIR_LEFT, PAIR_RIGHT) if k == 2 else (TRIPLE_LEFT, TRIPLE_RIGHT)
        sides = [right(kind, "n", *([f"w{i}" for i in range(k + 1)] if i == 0 else [f"w{j}" for j in range(1, k + 2)])) for i, kind in enumerate(kinds)]
        names = [f"w{i}" for i in range(1, k + 1)]
        return sides[0].select(*names, "n").unionByName(sides[1].select(*names, "n")).groupBy(*names).agg(F.max("n").alias("more"))

    def cut(df: DataFrame, *cuts: tuple[str, str, str]) -> DataFrame:
        """The cut of the lowest score, the first of equals."""
        best = F.array_min(F.array(*[F.struct(F.col(s).alias("score"), F.lit(i).alias("i"), F.col(x).alias("l"), F.col(y).alias("r")) for i, (s, x, y) in enumerate(cuts)]))
        rest = [c if c in df.columns else F.lit(None).cast("long").alias(c) for c in _KEYS]
        more = "more" if "more" in df.columns else F.lit(None).cast("long").alias("more")
        return df.withColumn("best", best).select("lang", *rest, "a", "best.l", "best.r", "best.score", more)

    two = cut(two.join(longer(2), ["w1", "w2"], "left"), ("score", "f1", "f2"))
    three = cut(three.join(longer(3), ["w1", "w2", "w3"], "left"), ("s1", "f1", "f23"), ("s2", "f12", "f3"))
    four = cut(four, ("s1", "f1", "f234"), ("s2", "f12", "f34"), ("s3", "f123", "f4"))
    every = two.unionByName(three).unionByName(four).where(F.col("score") >= bound)
    return written(every.where(F.col("more").isNull() | (100 * F.col("more") < plan.percent * F.col("a"))).drop("more"), "survivors")


def top_phrases(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to four words of each language.

    ``docs`` has lang (null: ``und``) and text (null: empty); other columns are ignored. Words are cut at blanks and tabs
    inside pieces of text without punctuation or line ends, A-Z lowered. Repeated rows count as often as they stand there;
    languages without candidates have no rows; an empty table gives an empty one. Ties are ordered by a, then by phrase in
    byte order.

    Best-first growth in rounds: all prefixes whose bound reaches ``frontiers[0]`` are expanded, level by level; a language is
    settled once ``top`` phrases of that score survive, since nothing unexpanded can reach them, and otherwise goes on with
    the next bound. The documents are read again for each level, without a shuffle of texts or of single occurrences: each
    chunk sends every phrase once. Counts are exact; words are told apart by 64-bit hashes.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(count_words(docs).where(F.col("w").isNull() | (F.col("n") >= plan.least)), "words")
    words = counts.where(F.col("w").isNotNull())
    table = Counts.of(words, ["w"], "n")
    open_docs, done = docs, []
    best = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    for bound in plan.frontiers:
        found = _round(open_docs, words, table, bound, plan)
        totals = found.groupBy("lang").count()
        settled = written(totals.where(F.col("count") >= plan.top) if bound else totals, "settled").select("lang")
        done.append(written(found.join(settled, "lang").withColumn("rank", F.rank().over(best)).where(F.col("rank") <= plan.top).drop("rank"), "best"))
        left = written(words.select("lang").distinct().join(settled, "lang", "left_anti"), "open") if bound else None
        if left is None or left.isEmpty():
            break
        open_docs = open_docs.join(left, "lang", "left_semi")
        words = written(words.join(left, "lang", "left_semi"), "words")
    chosen = reduce(DataFrame.unionByName, done)
    size = F.when(F.col("w3").isNull(), 2).when(F.col("w4").isNull(), 3).otherwise(4)
    wanted = {k: Counts.of(chosen.where(size == k), _KEYS[:k], "a") for k in (2, 3, 4)}
    match = reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in _KEYS])
    named = chosen.alias("c").join(_texts(docs, wanted).alias("t"), match).select("c.*", "t.phrase")
    totals = counts.where(F.col("w").isNull()).select("lang", "n")
    rank = F.row_number().over(best.orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))).cast("long")
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= plan.top).join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
