"""Repeated byte strings over all documents by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import remove, shared_folder, written
from evenkeel.llm.textwords import VISIBLE, Rolling, U, Words, mix

#: Bytes of text handled at once, unless one text alone is longer; a task needs about 150 times as many.
CHUNK_BYTES = 1_000_000
#: Contexts that a task remembers to have sent.
MAX_SENT = 100_000
#: Bits of the tables that tell which suffixes are wanted; a larger corpus only makes them let more through.
MAX_BITS = 1 << 28
#: Different contexts of one suffix that a single task compares; beyond that their strings are counted as rows.
MAX_GROUP = 50_000


@dataclass(frozen=True)
class Plan:
    """``length``: bytes of a repeated string. ``gram``: bytes that the anchors of the suffixes are chosen by.
    ``batches``: parts in which documents enter the index. ``words``: both lengths, and all places, are in words (A-Z lowered)
    instead of bytes. ``others``: only strings that stand in another document, too."""

    length: int = 400
    gram: int = 160
    batches: int = 4
    words: bool = False
    others: bool = False


#: Passages of 50 words that documents share with other ones.
PASSAGES = Plan(length=50, gram=16, batches=1, words=True, others=True)


@dataclass
class Anchors:
    """Sampled suffixes of some texts: every string of ``length`` bytes (or words) has one, at an offset its own bytes decide.

    ``data``: bytes, or hashes of words. ``text``: which text, ``low``/``high``: first and last start of the strings that choose the anchor (global),
    ``at``: the anchor, ``gram``: fingerprint of its first bytes, ``hull``: of all bytes of those strings.
    """

    data: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    hull: np.ndarray


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, 2**64 - 1, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_anchors(encoded: list[bytes], plan: Plan) -> Anchors:
    """The anchor of a string is the place of its smallest fingerprint of ``gram`` bytes, the leftmost of equals."""
    if plan.words:
        words = Words(encoded, VISIBLE)
        data, starts = words.hashes, words.first.astype(np.int64)
    else:
        data = np.frombuffer(b"".join(encoded), np.uint8)
        starts = np.cumsum([0, *map(len, encoded)], dtype=np.int64)
    sizes = np.diff(starts)
    n, k = len(data), plan.gram
    none = np.zeros(0, np.int64)
    if n < plan.length:
        return Anchors(data, starts, none, none, none, none, none.astype(U), none.astype(U))
    roll = Rolling(data)
    with np.errstate(over="ignore"):
        grams = mix((roll.sums[k:] - roll.sums[:-k]) * roll.inverse[: n - k + 1])
    key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    chosen = (_sliding_min(key, plan.length - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    long = sizes >= plan.length
    np.add.at(edge, starts[:-1][long], 1)
    np.add.at(edge, starts[1:][long] - plan.length + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge)[: len(chosen)] > 0)
    if not len(valid):
        return Anchors(data, starts, none, none, none, none, none.astype(U), none.astype(U))
    own = chosen[valid]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))))
    low, high = valid[cut], valid[np.concatenate((cut[1:] - 1, [len(valid) - 1]))]
    at = own[cut]
    hull = mix(roll.of(low, high + plan.length) ^ mix((at - low).astype(U)))
    text = np.searchsorted(starts, low, "right") - 1
    return Anchors(data, starts, text, low, high, at, grams[at], hull)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = batch.column(column).to_pylist()
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        e = t.encode()
        if size + len(e) > CHUNK_BYTES and held:
            yield first, i, held
            first, held, size = i, [], 0
        held.append(e)
        size += len(e)
    if held:
        yield first, len(texts), held


def batch_suffixes(docs: DataFrame, plan: Plan) -> DataFrame:
    """``batch, gram, hull, n`` of all anchored suffixes; equal ones of a chunk are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_numpy()
            for a, b, encoded in _pieces(batch, 0):
                x = find_anchors(encoded, plan)
                order = np.lexsort((x.text, x.hull, x.gram, parts[a:b][x.text]))
                if plan.others and len(order):  # one of the equal suffixes of a text
                    text, gram, hull = x.text[order], x.gram[order], x.hull[order]
                    order = order[np.concatenate(([True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (hull[1:] != hull[:-1])))]
                part, gram, hull = parts[a:b][x.text][order], x.gram[order], x.hull[order]
                new = np.concatenate(([True], (part[1:] != part[:-1]) | (gram[1:] != gram[:-1]) | (hull[1:] != hull[:-1])))[: len(gram)]
                at = np.flatnonzero(new)
                n = np.minimum(np.diff(np.concatenate((at, [len(gram)]))), 2)
                yield pa.record_batch(
                    [pa.array(part[at]), pa.array(gram[at].view(np.int64)), pa.array(hull[at].view(np.int64)), pa.array(n.astype(np.int32))],
                    ["batch", "gram", "hull", "n"],
                )

    return docs.select("text", "batch").mapInArrow(run, "batch int, gram long, hull long, n int")


class IndexFamily:
    """Suffix arrays whose sizes double: a new one is scanned against all, then equal sizes merge.

    An array is a table of different suffixes, ordered by fingerprints of their first ``gram`` bytes and of their whole
    context: any order that brings suffixes with a long common prefix together serves the scan. Matched prefixes are
    kept with the least and greatest context, which tells whether they have one or several.
    """

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.matches: list[DataFrame] = []

    def _store(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(self.spark, "suffix-array")
        rows.sortWithinPartitions("gram", "hull").write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    @staticmethod
    def _total() -> Column:
        return F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")

    def _merge(self) -> None:
        """Merge arrays of equal size; done when a new batch comes, so the last arrays need not be merged for nothing."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one, old), (_, two, older) = self.levels.pop(), self.levels.pop()
            merged, path = self._store(one.unionByName(two).groupBy("gram", "hull").agg(self._total()))
            remove(self.spark, old)
            remove(self.spark, older)
            self.levels.append((rank + 1, merged, path))

    def add(self, suffixes: DataFrame) -> None:
        """Enter a batch of (gram, hull, n): scan it with all arrays for prefixes that it shares with them or within."""
        self._merge()
        array, path = self._store(suffixes.groupBy("gram", "hull").agg(self._total()))
        every = array.withColumn("new", F.lit(True))
        for _, level, _ in self.levels:
            every = every.unionByName(level.withColumn("new", F.lit(False)))
        shared = every.groupBy("gram").agg(F.sum("n").alias("n"), F.min("hull").alias("lo"), F.max("hull").alias("hi"), F.max("new").alias("new"))
        self.matches.append(written(shared.where("n > 1 and new").select("gram", "lo", "hi"), "matches"))
        self.levels.append((0, array, path))

    def matched(self) -> DataFrame:
        """``gram, several``: prefixes that start at two places or more, and whether their contexts differ."""
        every = self.matches[0]
        for m in self.matches[1:]:
            every = every.unionByName(m)
        return every.groupBy("gram").agg((F.min("lo") != F.max("hi")).alias("several"))

    def close(self) -> None:
        for _, _, path in self.levels:
            remove(self.spark, path)
        self.levels = []


def _bit_table(grams: DataFrame) -> np.ndarray:
    """A table of bits of hashed prefixes; it never lacks one."""
    bits = min(MAX_BITS, 1 << max(16, (int(grams.count()) * 16).bit_length()))
    at = F.pmod("gram", F.lit(bits)) + 1
    have = np.zeros(bits // 8, np.uint8)
    rows = grams.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for r in rows.collect():  # MAX_BITS in all at most
        have[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return have


def _in(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = (grams & U(len(table) * 8 - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_STARTS = "array<struct<a:long,b:long>>"


def wanted_suffixes(docs: DataFrame, matched: DataFrame, plan: Plan) -> DataFrame:
    """All places of matched suffixes: ``doc_id, mark, gram, hull, n, starts, count, offset, context``.

    One row stands for the ``n`` equal suffixes of a text, so text of one short period, whose suffixes are as many as
    its bytes, gives few rows; ``starts`` has runs of starts of their strings. Documents are read again without a
    shuffle. ``context`` has the bytes where contexts of the prefix differ, once in each task.
    """
    tables = docs.sparkSession.sparkContext.broadcast((_bit_table(matched.select("gram")), _bit_table(matched.where("several").select("gram"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, several = tables.value
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, encoded in _pieces(batch, 2):
                x = find_anchors(encoded, plan)
                pick = np.flatnonzero(_in(some, x.gram))
                pick = pick[np.lexsort((x.low[pick], x.hull[pick], x.gram[pick], x.text[pick]))]
                text, gram, hull, low = x.text[pick], x.gram[pick], x.hull[pick], x.low[pick]
                count = x.high[pick] - low + 1
                group = np.concatenate(([True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (hull[1:] != hull[:-1])))[: len(pick)]
                run = group | np.concatenate(([True], low[1:] != low[:-1] + count[:-1]))[: len(pick)]
                first, begin = np.flatnonzero(group), np.flatnonzero(run)
                last = np.concatenate((begin[1:], [len(pick)]))[: len(begin)] - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array(low[begin] - x.starts[text[begin]]), pa.array((low + count)[last] - x.starts[text[begin]])], ["a", "b"]
                )
                starts = pa.ListArray.from_arrays(pa.array(np.concatenate((np.cumsum(run)[first] - 1, [len(begin)])), pa.int32()), runs)
                n = np.diff(np.concatenate((first, [len(pick)])))
                pick = pick[first]
                rich = _in(several, x.gram[pick])
                contexts: list[bytes | None] = [None] * len(pick)
                for i in np.flatnonzero(rich).tolist():
                    j = pick[i]
                    name = (int(x.gram[j]), int(x.hull[j]))
                    if name not in sent:
                        sent.add(name)
                        contexts[i] = x.data[x.low[j] : x.high[j] + plan.length].tobytes()
                if len(sent) > MAX_SENT:
                    sent.clear()
                text = x.text[pick]
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a).take(pa.array(text)), batch.column(1).slice(a, b - a).take(pa.array(text)),
                    pa.array(x.gram[pick].view(np.int64)), pa.array(x.hull[pick].view(np.int64)),
                    pa.array(n), starts, pa.array((x.high - x.low + 1)[pick].astype(np.int32)),
                    pa.array((x.at - x.low)[pick].astype(np.int32)), pa.array(contexts, pa.binary()),
                ], ["doc_id", "mark", "gram", "hull", "n", "starts", "count", "offset", "context"])

    return docs.select("doc_id", "mark", "text").mapInArrow(
        run, f"doc_id long, mark long, gram long, hull long, n long, starts {_STARTS}, count int, offset int, context binary"
    )


def _strings(contexts: list[bytes], counts: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of every context: its context, its number there, and its fingerprint with its anchor's place."""
    kind = np.dtype(U if plan.words else np.uint8)
    roll = Rolling(np.frombuffer(b"".join(contexts), kind))
    begin = np.cumsum([0, *map(len, contexts)])[:-1] // kind.itemsize
    own = np.repeat(np.arange(len(contexts)), counts)
    i = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[own] + i
    return own, i, mix(roll.of(start, start + plan.length) ^ mix((offsets[own] - i).astype(U)))


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


_RUNS = "gram long, hull long, runs array<struct<a:int,b:int>>"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def compare_contexts(contexts: DataFrame, plan: Plan) -> DataFrame:
    """``gram, hull, runs``: which strings of a context also stand in another one of its prefix, of another owner.

    Rows ``gram, hull, owner, count, offset, context`` are different suffixes. A group is held by one task up to MAX_GROUP
    contexts; those of larger groups are counted as rows instead.
    """
    sizes = contexts.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1")
    rows = contexts.join(sizes, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            keys = table.column("gram").to_numpy()
            counts, offsets = table.column("count").to_numpy().astype(np.int64), table.column("offset").to_numpy().astype(np.int64)
            own, _, prints = _strings(table.column("context").to_pylist(), counts, offsets, plan)
            group = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            owner = table.column("owner").to_numpy()[own]
            order = np.lexsort((owner, prints, group[own]))
            p, g, owner = prints[order], group[own][order], owner[order]
            begin = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (g[1:] != g[:-1]))))
            end = np.concatenate((begin[1:], [len(p)]))
            flags = np.zeros(len(own), bool)
            flags[order] = np.repeat(owner[begin] != owner[end - 1], end - begin)
            ends = np.cumsum(counts)
            hit = np.add.reduceat(flags, ends - counts) > 0
            at = np.flatnonzero(hit)
            runs = [[{"a": x, "b": y} for x, y in _spans(flags[ends[i] - counts[i] : ends[i]])] for i in at.tolist()]
            yield pa.record_batch(
                [table.column("gram").combine_chunks().take(pa.array(at)), table.column("hull").combine_chunks().take(pa.array(at)), pa.array(runs, _RUN_TYPE)],
                ["gram", "hull", "runs"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0).to_numpy()
            if keys[0] == keys[-1] and len(held) > 1 and held[0].column(0)[0].as_py() == keys[-1]:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])
            if cut:
                yield from done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    small = rows.where(F.col("size") <= MAX_GROUP).repartition("gram").sortWithinPartitions("gram")
    out = small.select("gram", "hull", "count", "offset", "context", "owner").mapInArrow(run, _RUNS)
    large = rows.where(F.col("size") > MAX_GROUP)
    if large.isEmpty():
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            own, i, prints = _strings(batch.column(4).to_pylist(), counts, offsets, plan)
            own = pa.array(own)
            yield pa.record_batch(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(i.astype(np.int32)), pa.array(prints.view(np.int64)), batch.column(5).take(own)],
                ["gram", "hull", "i", "print", "owner"],
            )

    strings = large.select("gram", "hull", "count", "offset", "context", "owner").mapInArrow(each, "gram long, hull long, i int, print long, owner long")
    often = strings.groupBy("gram", "print").agg((F.min("owner") != F.max("owner")).alias("other")).where("other").drop("other")
    one = F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))
    more = strings.join(often, ["gram", "print"]).groupBy("gram", "hull").agg(F.collect_list(one).alias("runs"))  # a context's strings
    return out.unionByName(more)


def repeated_spans(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, mark, spans`` for the documents with repeated bytes; ``docs`` has doc_id, mark and text (not null).

    ``spans`` are runs (start, stop) of bytes covered by strings of ``plan.length`` bytes that start at another place too, in
    the same or another document (``plan.others``: in another one); they may overlap. With ``plan.words``, all in words.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(plan.batches)).cast("int")
    path = shared_folder(spark, "suffixes")
    suffixes = batch_suffixes(docs.withColumn("batch", part), plan)
    suffixes.write.partitionBy("batch").parquet(path)
    family = IndexFamily(docs)
    for b in range(plan.batches):
        family.add(spark.read.schema(suffixes.schema).parquet(path).where(F.col("batch") == b).select("gram", "hull", "n"))
    remove(spark, path)
    family.close()
    matched = family.matched()
    places_path = shared_folder(spark, "places")
    places = wanted_suffixes(docs, matched, plan)
    places.write.parquet(places_path)
    places = spark.read.schema(places.schema).parquet(places_path)
    places_n = F.count("*") if plan.others else F.sum("n")
    kinds = places.groupBy("gram", "hull").agg(
        places_n.alias("n"), F.first("count").alias("count"), F.first("offset").alias("offset"), F.max("context").alias("context"),
        F.first(F.xxhash64("doc_id", "mark")).alias("doc"),
    )
    owner = F.when(F.col("n") == 1, F.col("doc")).otherwise(F.col("hull")) if plan.others else F.col("hull")
    full = kinds.where("n > 1").select("gram", "hull", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
    several = kinds.where(F.col("context").isNotNull())
    partly = compare_contexts(several.select("gram", "hull", "count", "offset", "context", owner.alias("owner")), plan)
    partly = partly.join(kinds.where("n = 1").select("gram", "hull"), ["gram", "hull"], "left_semi")
    status = full.unionByName(partly)
    shifted = lambda low: F.transform("runs", lambda r: F.struct((low + r["a"]).alias("a"), (low + r["b"]).alias("b")))
    equal = lambda s: F.sequence(F.lit(0).cast("long"), F.floor((s["b"] - s["a"]) / F.col("count")) - 1)
    some = F.flatten(F.transform("starts", lambda s: F.flatten(F.transform(equal(s), lambda j: shifted(s["a"] + j * F.col("count"))))))
    covered = lambda r: F.struct(r["a"].alias("start"), (r["b"] - 1 + plan.length).alias("stop"))
    span = F.transform(F.when(F.col("runs").isNull(), F.col("starts")).otherwise(some), covered)
    hits = places.select("doc_id", "mark", "gram", "hull", "starts", "count").join(status, ["gram", "hull"])
    spans = written(hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list(span)).alias("spans")), "spans")  # a document's own
    remove(spark, places_path)
    return spans


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, plan: Plan = Plan(), passages: Plan = PASSAGES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept`` (the bytes that stay) of every document.

    Every byte covered by a string of ``plan.length`` bytes that starts anywhere else too is removed, in all its places;
    strings are judged on the input. ``n_passage_words`` only reports: words inside passages of ``passages.length`` words
    that another document has, too, shorter than such a string or not. A null text is empty; texts shorter than the
    length keep all. Rows that repeat id and text repeat each other. An empty table gives an empty one. Other columns are
    ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    key = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("mark").alias("__mark")]
    on = ["__id", "__none", "__mark"]
    spans = repeated_spans(rows, plan).select(*key, "spans")
    both = spans.join(repeated_spans(rows, passages).select(*key, F.col("spans").alias("passages")), on, "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans, passages in zip(*[c.to_pylist() for c in batch.columns]):
                data, gone = text.encode(), _union(spans or [])
                cuts = [0, *[x for s in gone for x in s], len(data)]
                kept = b"".join([data[a:b] for a, b in zip(cuts[::2], cuts[1::2])])
                shared = sum(b - a for a, b in _union(passages or []))
                out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), shared, kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    joined = rows.select("doc_id", "text", *key).join(both, on, "left").select("doc_id", "text", "spans", "passages")
    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary"
    )
