"""Near-duplicate documents by a chosen-path set similarity join on min-wise tokens, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import components
from evenkeel.llm.pretokens import text_parts
from evenkeel.llm.shared import Tables, written
from evenkeel.llm.textwords import VISIBLE, U, Words, mix

CHUNK_CHARS = 250_000
#: Shingles hashed at once: their products with all factors stay in a core's cache.
BLOCK_SHINGLES = 64
#: Columns of a tree's rows that do not change while the tree branches.
CARRIED = ["tree", "node", "label", "tokens", "paths", "whole"]
TREE_SCHEMA = "path long, tree int, node binary, label binary, tokens binary, paths binary, whole long"
#: Bits of the table that tells which sets are wanted; a larger corpus only makes it let more sets through.
MAX_BITS = 1 << 28


@dataclass(frozen=True)
class Plan:
    """Parameters of the join.

    A set is reduced to ``tokens`` min-wise tokens, of which 8 bits are kept. Each of ``trees`` branches all sets by ``depth`` of them, drawn for
    the tree; a node of over ``node`` sets branches on by two more drawn tokens at each level, ``levels`` times. A pair
    at the threshold agrees on a path with probability ``jaccard ** depth``, so all trees miss it with
    ``(1 - jaccard ** depth) ** trees``: 1e-10 at 0.85 and 4e-8 at 0.8. Pairs whose agreement is ``slack`` standard
    deviations below the threshold are not confirmed (3e-6).
    """

    shingle: int = 3
    percent: int = 85
    tokens: int = 512
    trees: int = 24
    depth: int = 3
    node: int = 2000
    levels: int = 12
    slack: float = 4.5
    seed: int = 3

    def __post_init__(self) -> None:
        if not 1 <= self.trees <= 63:
            raise ValueError("1 to 63 trees: a set's trees are marked in one long")

    @cached_property
    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**63, self.tokens, dtype=np.uint64) | U(1)

    @cached_property
    def drawn(self) -> np.ndarray:
        """The tokens that each tree branches by; as long as there are enough, no two trees share one."""
        rng = np.random.default_rng(self.seed + 1)
        need = self.trees * self.depth
        every = np.concatenate([rng.permutation(self.tokens) for _ in range(-(-need // self.tokens))])
        return every[:need].reshape(self.trees, self.depth)

    @property
    def least(self) -> float:
        j = self.percent / 100
        j = j + (1 - j) / 256  # different tokens agree on 8 bits by chance
        return j - self.slack * (j * (1 - j) / self.tokens) ** 0.5


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the k-word shingles of each text; a shorter text is one shingle."""
    w = Words(texts, VISIBLE)
    n = len(w)
    grams = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            grams[: max(0, n - j)] = mix(grams[: max(0, n - j)] * U(0x9E3779B97F4A7C15) + w.hashes[j:] + U(j))
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            whole = U(b - a)
            with np.errstate(over="ignore"):
                for h in w.hashes[a:b]:
                    whole = mix(np.array([whole * U(0x9E3779B97F4A7C15) + h + U(1 << 40)], U))[0]
            out.append(np.array([whole] if b > a else [], U))
    return out


def digest(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def min_tokens(values: np.ndarray, plan: Plan) -> tuple[bytes, bytes]:
    """The path of a set in each tree (64 bits), and 8 bits of its min-wise token of each hash function."""
    best = np.full(plan.tokens, 2**64 - 1, U)
    with np.errstate(over="ignore"):
        room = np.empty((2, min(BLOCK_SHINGLES, len(values)), plan.tokens), U)
        for a in range(0, len(values), BLOCK_SHINGLES):
            block = values[a : a + BLOCK_SHINGLES, None]
            part, high = room[:, : len(block)]
            np.multiply(block, plan.factors[None, :], out=part)
            np.right_shift(part, U(32), out=high)
            np.bitwise_xor(part, high, out=part)
            np.minimum(best, part.min(axis=0), out=best)
        best = mix(best)
        path = np.arange(1, plan.trees + 1, dtype=U)
        for level in range(plan.depth):
            path = mix(path * U(0x9E3779B97F4A7C15) + best[plan.drawn[:, level]])
    return path.tobytes(), best.astype("u1").tobytes()


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for part in text_parts(batch, 1, CHUNK_CHARS):
            yield part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), k)


def sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, n_shingles, node`` (a 128-bit digest of the set), ``paths``, ``tokens`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, plan.shingle):
            found = [min_tokens(s, plan) if len(s) else (b"", b"") for s in sets]
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(digest, sets), pa.binary()),
                *[pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)],
            ], ["doc_id", "n_shingles", "node", "paths", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node binary, paths binary, tokens binary")


def _matrix(column: pa.Array, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, tokens)


def paths(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``path, tree, node``: the tree node that each set falls into, for every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, plan.trees)
            for t in range(plan.trees):
                tree = pa.array(np.full(len(m), t, np.int32))
                yield pa.record_batch([pa.array(np.ascontiguousarray(m[:, t])), tree, batch.column(0)], ["path", "tree", "node"])

    return nodes.select("node", "paths").mapInArrow(run, "path long, tree int, node binary")


def _place(node: bytes, rep: int | None, bits: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(node + repr(rep).encode()) & (bits - 1)


def wanted_sets(docs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """``node, shingles`` of the sets in ``nodes(node, rep)``, from the documents; some others and repeats may come too.

    Documents are read once more, without a shuffle: a table of bits says which (set, document) are wanted.
    """
    bits = min(MAX_BITS, 1 << max(16, (int(nodes.count()) * 16).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_place(node, rep, bits) + 1 for node, rep in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.record_batch([pa.array(at, pa.int64())], ["at"])

    have = np.zeros(bits // 8, np.uint8)
    buckets = nodes.select("node", "rep").mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    for r in buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():  # MAX_BITS at most
        have[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for ids, sets in _batches(batches, plan.shingle):
            keep = []
            for rep, s in zip(ids, sets):
                at = _place(node := digest(s), rep, bits)
                if table[at >> 3] >> (at & 7) & 1:
                    keep.append((node, s.tobytes()))
            yield pa.record_batch([pa.array([x[i] for x in keep], pa.binary()) for i in (0, 1)], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "node binary, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach ``percent`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _likely(m: np.ndarray, least: float, after: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``m``: its number, the rows (``after``: those after it) whose tokens agree often enough, and how often."""
    columns = np.ascontiguousarray(m.T)
    for i in range(len(m)):
        first = i + 1 if after else 0
        same = np.zeros(len(m) - first, np.int64)
        for a in range(0, len(columns), 255):  # sums of a byte hold so many
            part = columns[a : a + 255]
            same += np.add.reduce((part[:, first:] == part[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint8)
        share = same / len(columns)
        hit = np.flatnonzero(share >= least)
        yield i, hit + first, share[hit]


def compare_nodes(rows: DataFrame, plan: Plan, best: bool) -> DataFrame:
    """Likely pairs ``a, b`` in each tree node of ``rows``, never inside one label.

    A node holds at most ``plan.node`` sets. ``best`` gives each set's likeliest partner only. Otherwise pairs that share
    a whole path (64 bits) of an earlier tree are left to it, if its node was compared as it is: ``whole`` has a bit for
    each such tree.
    """

    def pairs_of(part: pa.Table, label: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        names, m = part.column("node").to_pylist(), _matrix(part.column("tokens"), plan.tokens)
        tree = part.column("tree")[0].as_py()
        way = None if best else np.frombuffer(b"".join(part.column("paths").to_pylist()), "<i8").reshape(-1, plan.trees)[:, :tree]
        whole = part.column("whole").to_numpy()[:, None] >> np.arange(tree) & 1 == 1
        for i, hit, share in _likely(m, plan.least, after=not best):
            ok = label[hit] != label[i]
            hit, share = hit[ok], share[ok]
            if best and len(hit):
                j = int(hit[np.argmax(share)])
                yield min(names[i], names[j]), max(names[i], names[j])
            elif not best:
                met = ((way[hit] == way[i]) & whole[i]).any(axis=1)
                for j in hit[~met].tolist():
                    yield min(names[i], names[j]), max(names[i], names[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(group: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = group.column("path").to_numpy()
            for a, b in _runs(keys):
                part = group.slice(a, b - a).combine_chunks()
                _, label = np.unique(np.array(part.column("label").to_pylist(), object), return_inverse=True)
                if label.max() == 0:
                    continue
                found = list(pairs_of(part, label))
                yield pa.record_batch([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column("path").to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])
            if cut:  # the last node may go on in the next batch
                yield from done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    ordered = rows.repartition("path").sortWithinPartitions("path").select("path", *CARRIED)
    return ordered.mapInArrow(run, "a binary, b binary")


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows`` of the tree nodes that hold more than one label, with the number of their sets as ``size``."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return rows.join(sizes.where("lo <> hi").select("path", "size"), "path")


def _branch(rows: DataFrame, level: int, plan: Plan) -> DataFrame:
    """Each set of a large tree node goes on to two children, by two tokens drawn for the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(4), plan.tokens)
            path = batch.column(0).to_numpy().view(U)
            for child in range(2):
                with np.errstate(over="ignore"):
                    drawn = (mix(path + U(level * 2 + child)) % U(plan.tokens)).astype(np.int64)
                    key = mix(path * U(0x9E3779B97F4A7C15) + drawn.astype(U)) ^ mix(m[np.arange(len(m)), drawn].astype(U) + U(child))
                yield pa.record_batch([pa.array(key.view(np.int64)), *batch.columns[1:]], batch.schema.names)

    return rows.select("path", *CARRIED).mapInArrow(run, TREE_SCHEMA)


def _blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Tree nodes that no longer shrink, cut into pairs of blocks that are small nodes of their own."""
    half = plan.node // 2
    count = F.ceil(F.col("size") / half).cast("int")
    block = F.pmod(F.xxhash64("node", "path"), count).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    out = rows.withColumn("__n", count).withColumn("__b", block).withColumn("__o", other)
    pair = F.xxhash64("path", F.least("__b", "__o"), F.greatest("__b", "__o"))
    return out.select(pair.alias("path"), *CARRIED)


def unlinked_pairs(rows: DataFrame, plan: Plan, best: bool, made: Tables) -> DataFrame:
    """Likely pairs between labels over all tree nodes; large nodes branch on until they are small."""
    rows, found, level = made.written(_mixed(rows), "tree"), [], 0
    while True:
        found.append(compare_nodes(rows.where(F.col("size") <= plan.node), plan, best))
        large = rows.where(F.col("size") > plan.node)
        if large.isEmpty():
            break
        if level == plan.levels:
            found.append(compare_nodes(_blocks(large, plan), plan, best))
            break
        rows, level = made.written(_mixed(_branch(large, level, plan)), "tree"), level + 1
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Sets equal in all shingles are one node from the start. Three rounds of confirmation on full sets follow: first
    each set with the smallest set of the tree node that it shares most trees with; then, in tree nodes that still hold
    several components, each set's likeliest partner of another component; then all likely pairs between components.
    Pairs inside a component need no confirmation. So links grow with the documents, not with the square of a group.

    ``component_id`` is the smallest doc_id of the component. Documents without words (null, empty) have an empty set
    and are linked with nothing. Rows that repeat a doc_id keep their own texts' links; nulls in doc_id count last. An
    empty table gives an empty table; other columns are ignored.
    """
    sketched = Tables(docs.sparkSession)
    every = sketched.written(sketch(docs, plan), "sketch")
    nodes = every.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.any_value("paths").alias("paths"), F.any_value("tokens").alias("tokens")
    )
    nodes = written(nodes, "nodes")
    every = written(every.drop("paths", "tokens"), "digests")
    sketched.remove()
    rows = paths(nodes, plan)
    shared = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n")
    shared = written(rows.join(shared, "path"), "tree")
    wanted = shared.select("node").distinct().join(nodes.select("node", "rep"), "node")
    sets = written(wanted_sets(docs, wanted, plan).dropDuplicates(["node"]), "sets")

    often = shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    first = often.groupBy("node").agg(F.max_by("pivot", "n").alias("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = written(confirm(first, sets, plan.percent), "links")
    label = components(links)
    for best in (True, False):
        marked = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = _mixed(marked.select("path", "tree", "node", "label"))
        small = F.when(F.col("size") <= plan.node, F.expr("shiftleft(1L, tree)")).otherwise(F.lit(0).cast("long"))
        whole = mixed.groupBy("node").agg(F.bit_or(small).alias("whole"))
        if best:  # every set names its partner in each tree anew, so earlier trees do not matter
            about = nodes.select("node", "tokens", F.lit(b"").alias("paths"), F.lit(0).cast("long").alias("whole"))
        else:
            about = nodes.select("node", "tokens", "paths").join(whole, "node")
        mixed = mixed.drop("size").join(about, "node").select("path", *CARRIED)
        trees = Tables(docs.sparkSession)
        more = written(confirm(unlinked_pairs(mixed, plan, best, trees), sets, plan.percent), "links")
        trees.remove()
        links = links.unionByName(more)
        label = components(links)
    ids = nodes.join(label, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = ids.groupBy("label").agg(F.min("rep").alias("component"))
    ids = ids.join(smallest, "label").select(F.col("node").alias("__node"), "component")
    out = every.join(ids, (F.col("node") == F.col("__node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, plan: Plan) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id, with the columns it came with.

    Of rows that repeat an id and are all kept, all stay.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), plan).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
