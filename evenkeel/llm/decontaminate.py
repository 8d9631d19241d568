"""Benchmark passages in documents, by a prefix-filtered set join with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.pretokens import chunks
from evenkeel.llm.shared import lower_ascii
from evenkeel.llm.textwords import ALPHANUMERIC, Rolling, Words, mix

WINDOW = 13
SHINGLE = 3
#: Windows that are held by every task at once; larger benchmarks are taken in blocks of about so many.
BLOCK_WINDOWS = 200_000
CHUNK_CHARS = 1_000_000
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window): the words of each window in lower case, joined by blanks.

    An item with fewer words than a window, but not none, is one window.
    """
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.concat_ws(" ", F.slice("words", i + 1, window)))
    short = F.array(F.concat_ws(" ", "words"))
    return rows.select("item_id", F.explode(F.when(F.size("words") < window, short).otherwise(cut)).alias("window")).distinct()


def _shingles(w: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; meaningless in the last k-1 words of a text."""
    n = len(w)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out[: n - j] = mix(out[: n - j] * np.uint64(31) + w.hashes[j:] + np.uint64(k))
    return out


class Block:
    """Some windows with their shingles: what a task needs to find them."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.texts = sorted({w for _, w in rows})
        number = {w: i for i, w in enumerate(self.texts)}
        self.items: list[list[int]] = [[] for _ in self.texts]
        for item, w in rows:
            if item is not None:
                self.items[number[w]].append(item)
        words = Words(self.texts, ALPHANUMERIC)
        first = words.first
        self.sizes = np.diff(first)
        self.hashes = Rolling(words.hashes).of(first[:-1], first[1:])
        self.owners, self.offsets, grams, self.k = [], [], [], np.minimum(self.sizes, SHINGLE)
        for k in np.unique(self.k):
            every = _shingles(words, int(k))
            for i in np.flatnonzero(self.k == k).tolist():
                span = range(int(self.sizes[i] - k) + 1)
                self.owners += [i] * len(span)
                self.offsets += span
                grams.append(every[first[i] : first[i] + len(span)])
        self.grams = np.concatenate(grams)
        self.distinct = np.unique(self.grams)
        self.owners, self.offsets = np.array(self.owners), np.array(self.offsets)
        self.lengths = np.unique(self.k).tolist()

    def keep_prefixes(self, counts: np.ndarray) -> None:
        """Keep the rarest shingle of each window: one that occurs nowhere else rules the window out.

        The window must be contained whole, so a prefix of one shingle in the order of rarity is enough.
        """
        rarity = counts[np.searchsorted(self.distinct, self.grams)]
        order = np.lexsort((self.grams, rarity, self.owners))
        order = order[np.concatenate(([True], np.diff(self.owners[order]) > 0))]
        order = order[np.argsort(self.grams[order], kind="stable")]
        self.grams, self.owners, self.offsets = self.grams[order], self.owners[order], self.offsets[order]
        self.distinct = np.unique(self.grams)


def _gate(keys: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << 22, bool)
    gate[(keys >> np.uint64(42)).astype(np.int64)] = True
    return gate


def _found(w: Words, keys: np.ndarray, gate: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which one of the sorted shingles ``keys`` stands, and which."""
    at, which = [], []
    ends = np.repeat(w.first[1:], np.diff(w.first))
    for k in lengths:
        h = _shingles(w, k)
        i = np.flatnonzero(gate[(h >> np.uint64(42)).astype(np.int64)])
        j = np.searchsorted(keys, h[i])
        ok = (j < len(keys)) & (keys[np.minimum(j, len(keys) - 1)] == h[i]) & (i + k <= ends[i])
        at.append(i[ok])
        which.append(j[ok])
    return np.concatenate(at), np.concatenate(which)


def _count_shingles(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((block.distinct, block.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = shared.value
        gate, total = _gate(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                total += np.bincount(_found(Words(texts[a:b], ALPHANUMERIC), keys, gate, lengths)[1], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["shingle", "n"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = np.zeros(len(block.distinct), np.int64)
    for r in text.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect():
        counts[r.shingle] = r.n
    shared.destroy()
    return counts


def _scan(w: Words, block: Block, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all true occurrences."""
    at, which = _found(w, block.distinct, gate, block.lengths)
    low, high = np.searchsorted(block.grams, block.distinct[which]), np.searchsorted(block.grams, block.distinct[which], "right")
    each = high - low
    row = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    window, begin = block.owners[row], np.repeat(at, each) - block.offsets[row]
    text = np.searchsorted(w.first, np.repeat(at, each), "right") - 1
    size = block.sizes[window]
    ok = (begin >= w.first[text]) & (begin + size <= w.first[text + 1])  # position and length
    window, begin, size = window[ok], begin[ok], size[ok]
    ok = Rolling(w.hashes).of(begin, begin + size) == block.hashes[window]
    window, begin, size = window[ok], begin[ok], size[ok]
    same = [w.joined(b, b + s).decode() == block.texts[i] for b, s, i in zip(begin.tolist(), size.tolist(), window.tolist())]
    same = np.array(same, bool)
    return begin[same], window[same]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions of words inside occurring windows) and ``hit_items``.

    Every window is looked for in every document. Benchmarks beyond BLOCK_WINDOWS windows are searched for in blocks,
    one after the other, so what a task holds stays bounded; frequencies of shingles are counted over all documents.
    Null and empty texts have no words. A row of ``benchmark`` with a null id hits words but is no item; an empty
    benchmark hits nothing. Documents are not shuffled. Raises ``ValueError`` if ``docs`` has columns of those names.
    """
    new = ["n_words", "hit_words", "hit_items"]
    if set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(set(new) & set(docs.columns))} clash with the result")
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit("")).alias("text")
    out = docs.select(*[docs[c] for c in keep], docs["text"].alias("__text") if keep_text else F.lit(None).cast("string").alias("__text"), text)
    windows = item_windows(benchmark, window).persist()
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    part = F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<bigint>")})
    for i in range(blocks):
        rows = [(r.item_id, r.window) for r in windows.where(part == i).collect()]  # about BLOCK_WINDOWS
        out = _mark_block(out, docs, rows)
        if blocks > 1:
            out = out.checkpoint()
    windows.unpersist()
    out = out.drop("text")
    return out.withColumnRenamed("__text", "text") if keep_text else out.drop("__text")


def _mark_block(out: DataFrame, docs: DataFrame, rows: list[tuple[int | None, str]]) -> DataFrame:
    block = Block(rows) if rows else None
    if block is not None:
        block.keep_prefixes(_count_shingles(docs, block))
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = out.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        gate = None if block is None else _gate(block.distinct)
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                part = batch.slice(a, b - a)
                w = Words(texts[a:b], ALPHANUMERIC)
                hits = [set(x) for x in part.column("hit_words").to_pylist()]
                items = [set(x) for x in part.column("hit_items").to_pylist()]
                if block is not None and len(w):
                    begin, window = _scan(w, block, gate)
                    text = np.searchsorted(w.first, begin, "right") - 1
                    for t, p, i in zip(text.tolist(), (begin - w.first[text]).tolist(), window.tolist()):
                        hits[t].update(range(p, p + int(block.sizes[i])))
                        items[t].update(block.items[i])
                done = {
                    "n_words": pa.array(np.diff(w.first), pa.int64()),
                    "hit_words": pa.array([sorted(x) for x in hits], pa.list_(pa.int32())),
                    "hit_items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                }
                yield pa.record_batch([done.get(c, part.column(k)) for k, c in enumerate(names)], names)

    return out.mapInArrow(run, out.schema)


def contaminated() -> Column:
    """Whether a marked document counts as contaminated: a twentieth of its words or more are hit."""
    return (F.size("hit_words") > 0) & (20 * F.size("hit_words") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return mark(docs, benchmark, keep_text=True).where(~contaminated()).select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, hit words, items found and verdict."""
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
