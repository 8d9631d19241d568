"""Repair of conversations by weighted interval parsing, for many conversations at once and for very long ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.columns import BLANKS
from evenkeel.llm.shared import written

#: Turns of one block; longer conversations are parsed block by block, in different tasks.
BLOCK = 1 << 16
#: Where a repaired conversation can stand: nothing yet, after a system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Turns as the parser sees them: initial of the role (s, u, a, other) and whether sound, truncated or to be deleted.
SOUND, TRUNCATED, DOOMED = range(3)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Insertions that complete a conversation.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
INSERT, DELETE, REROLE, CUT_SHORT = 3, 4, 3, 3
FAR = 1 << 40


def _grammar() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cells of spans of one turn: for each symbol, the cheapest (cost, edits) from one state to another.

    A cell ``X(p, q)`` is a nonterminal: the turns of a span, edited, lead from state p to q; the binary rule is
    ``X(p, q) -> X(p, r) X(r, q)``. Insertions before a turn belong to its cell (their closure is taken here), those at the
    end to ``CLOSING``. So all edits of a span have the form (I*, D or K or R) once a turn. No such code is the beginning of
    another one, therefore the least concatenation is made of least parts and spans can be ranked.
    """
    units: dict[tuple[int, int, int], tuple[int, str]] = {}
    for symbol in range(12):
        role, fault = divmod(symbol, 3)
        for p in STATES:
            at, lead = p, ""
            for _ in range(4):  # more insertions only come round again
                options = [("D", at, DELETE)]
                if fault != DOOMED:
                    extra = CUT_SHORT * (fault == TRUNCATED)
                    options.append(("R", NEXT[at], REROLE + extra))
                    if (role == 0 and at == START) or (role in (1, 2) and NEXT[at] == (USER, ASSISTANT)[role - 1]):
                        options.append(("K", (SYSTEM, USER, ASSISTANT)[role], extra))
                for edit, q, cost in options:
                    found = (cost + INSERT * len(lead), lead + edit)
                    units[symbol, p, q] = min(units.get((symbol, p, q), found), found)
                at, lead = NEXT[at], lead + "I"
    codes = sorted({u for _, u in units.values()})
    cost, code = np.full((12, 4, 4), FAR, np.int64), np.zeros((12, 4, 4), np.int64)
    for at, (c, u) in units.items():
        cost[at], code[at] = c, codes.index(u)
    return codes, cost, code


CODES, UNIT_COST, UNIT_CODE = _grammar()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks inside each row."""
    order = np.argsort(keys, axis=1, kind="stable")
    ordered = np.take_along_axis(keys, order, 1)
    steps = np.cumsum(np.concatenate((np.zeros((len(keys), 1), np.int64), ordered[:, 1:] != ordered[:, :-1]), axis=1), axis=1)
    out = np.empty_like(keys)
    np.put_along_axis(out, order, steps, 1)
    return out


UNIT_RANK = _ranks(UNIT_CODE.reshape(12, 16)).reshape(12, 4, 4)


class Chart:
    """The cells of blocks of turns, from spans of one turn upwards: spans of 1, 2, 4, 8, ... turns are combined.

    Every run through the states stands in some state at every place, so all ways to divide a span give the same cells
    and one is enough. ``cost`` and ``rank`` (order of the edits) have the cells of each whole block.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        """``sizes``: turns of each block, none of them 0."""
        self.symbols = symbols
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cost, rank = UNIT_COST[symbols], UNIT_RANK[symbols]
        counts = sizes.astype(np.int64)
        while len(counts) and counts.max() > 1:
            begin = np.cumsum(counts) - counts
            half = (counts + 1) // 2
            block = np.repeat(np.arange(len(counts)), half)
            place = np.arange(len(block)) - np.repeat(np.cumsum(half) - half, half)
            left = begin[block] + 2 * place
            paired = 2 * place + 1 < counts[block]
            a, b = left[paired], left[paired] + 1
            total = cost[a][:, :, :, None] + cost[b][:, None, :, :]
            order = rank[a][:, :, :, None] * 16 + rank[b][:, None, :, :]
            choice = (total * 256 + order).argmin(2)
            pick = choice[:, :, None, :]
            new_cost, new_rank = cost[left], rank[left]
            new_cost[paired] = np.minimum(np.take_along_axis(total, pick, 2)[:, :, 0], FAR)
            new_rank[paired] = _ranks(np.take_along_axis(order, pick, 2)[:, :, 0].reshape(-1, 16)).reshape(-1, 4, 4)
            full = np.zeros((len(left), 4, 4), np.uint8)
            full[paired] = choice
            self.levels.append((left, paired, full))
            cost, rank, counts = new_cost, new_rank, half
        self.cost, self.rank = cost, rank

    def edits(self, block: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[str]:
        """The edits of the given cells of whole blocks."""
        node, own = block.astype(np.int64), np.arange(len(block))
        for left, paired, choice in reversed(self.levels):
            two = paired[node]
            r = choice[node, p, q]
            place = np.cumsum(1 + two) - 1 - two  # of the first part
            size = len(node) + int(two.sum())
            parts = np.empty((4, size), np.int64)
            parts[:, place] = left[node], p, np.where(two, r, q), own
            parts[:, place[two] + 1] = left[node][two] + 1, r[two], q[two], own[two]
            node, p, q, own = parts
        codes = UNIT_CODE[self.symbols[node], p, q].tolist()
        ends = np.searchsorted(own, np.arange(len(block) + 1)).tolist()
        return ["".join([CODES[c] for c in codes[a:b]]) for a, b in zip(ends, ends[1:])]


class Opening:
    """The cells from the start of a conversation to the end of its blocks so far."""

    def __init__(self) -> None:
        self.cost, self.rank = [0, FAR, FAR, FAR], [0, 0, 0, 0]
        self.chain: list[tuple | None] = [None] * 4

    def add(self, cost: list[int], rank: list[int], edits: list[str]) -> None:
        """Append a block; its cells are given row by row."""
        best = [min((self.cost[r] + cost[4 * r + q], self.rank[r], rank[4 * r + q], r) for r in STATES) for q in STATES]
        order = sorted({b[1:3] for b in best})
        self.chain = [(self.chain[b[3]], edits[4 * b[3] + q]) for q, b in zip(STATES, best)]
        self.cost, self.rank = [min(b[0], FAR) for b in best], [order.index(b[1:3]) for b in best]

    def close(self) -> tuple[int, str]:
        """Cost and edits of the whole conversation."""
        cost, _, q = min((self.cost[q] + INSERT * len(CLOSING[q]), self.rank[q], q) for q in STATES)
        parts, link = [CLOSING[q]], self.chain[q]
        while link is not None:
            parts.append(link[1])
            link = link[0]
        return cost, "".join(reversed(parts))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults of a test: ``copies`` says how often a row now stands there.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (no copies), 1 empties its text, 2 takes its
    ``.``, ``!`` and ``?`` away, 3 doubles it, 4 makes it a user's. Nulls count as one blank.
    """
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(said.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with plain types and ``digest``, which tells equal role and text of one conversation."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"),
    )
    whose = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    return plain.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", whose, F.length("role").cast("string"), "role", "text"))))


_STATS = ("turns", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "n_turn", "low", "high")
_BLOCKS = "conv_id long, turn long, digest binary, number long, whole boolean, stats array<long>, cost array<long>, rank array<long>, edits array<string>"


def _symbols(rows: DataFrame, most: int) -> DataFrame:
    """Different turns of each conversation as symbols, without their texts: ``conv_id, turn, digest, role, fault, again, copies``.

    Equal rows are counted map-side. ``again``: role and text stood in an earlier turn. ``fault``: 2 blank, 1 cut short.
    """
    text = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3))
    fault = F.when(text == "", 2).when(F.right(text, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    light = rows.where("copies > 0").select("conv_id", "turn", "digest", (initial * 3 + fault).cast("byte").alias("look"), "copies")
    once = written(light.groupBy("conv_id", "turn", "digest", "look").agg(F.sum("copies").alias("copies")), "turns")
    # the null turn comes first; only rows met in several turns are joined
    many = once.groupBy("digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("m"), F.count("*").alias("n"))
    many = many.where("n > 1").select("digest", F.struct("m.turn").alias("first"))
    later = once.join(many, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most)))
    parts = later.select("conv_id", "turn", "digest", "look", again.alias("again"), "copies", piece.alias("piece"))
    return parts.select(
        "conv_id", "turn", "digest", "look", (F.col("again") | (F.col("piece") > 0)).alias("again"), "piece",
        F.least(F.lit(most), F.col("copies") - F.col("piece") * most).cast("int").alias("copies"),
    )


def _parse(held: pa.RecordBatch, number: int, most: int) -> pa.RecordBatch:
    """Blocks of consecutive turns. A conversation inside the table is one or more whole blocks; its first and last one
    may go on elsewhere. Finished conversations of one block have their cheapest edits only, other blocks all cells."""
    conv = held.column("conv_id")
    null = np.asarray(conv.is_null())
    ids = np.asarray(conv.fill_null(0))
    rows = len(ids)
    copies = np.asarray(held.column("copies")).astype(np.int64)
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    filled = np.cumsum(copies)
    inside = (filled - (filled[begin] - copies[begin])[run] - 1) // most  # the block of the run that a row ends in
    cut = np.concatenate(([True], new[1:] | (inside[1:] != inside[:-1])))
    at = np.flatnonzero(cut)
    block = np.cumsum(cut) - 1
    look = np.asarray(held.column("look")).astype(np.int64)
    again = np.asarray(held.column("again"))
    role, fault = look // 3, look % 3
    # each row stands for its first copy and the equal ones after it
    source = np.repeat(np.arange(rows), copies)
    lead = np.zeros(len(source), bool)
    lead[np.cumsum(copies) - copies] = True
    f = fault[source]
    twin = (f != 2) & (~lead | again[source])
    symbol = role[source] * 3 + np.where((f == 2) | twin, DOOMED, np.where(f == 1, TRUNCATED, SOUND))
    of = block[source]
    sizes = np.bincount(of, minlength=len(at))
    chart = Chart(symbol, sizes)
    count = lambda flags: np.bincount(of[flags], minlength=len(at))
    r = role[source]
    legal = np.isin(r[:-1] * 4 + r[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    illegal = np.concatenate(([False], ~legal & (of[1:] == of[:-1])))
    turn = held.column("turn")
    has = ~np.asarray(turn.is_null())
    turns = np.asarray(turn.fill_null(0))
    fresh = has & np.concatenate(([True], cut[1:] | (turns[1:] != turns[:-1]) | ~has[:-1]))
    n_turn = np.bincount(block[fresh], minlength=len(at))
    low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    seen = np.flatnonzero(has)
    high[block[seen]] = turns[seen]  # rows are in order, the last one stays
    low[block[seen[::-1]]] = turns[seen[::-1]]
    ends = np.cumsum(sizes)
    stats = np.stack([sizes, count(f == 2), count(twin), count((f == 1) & ~twin), count(illegal), r[ends - sizes], r[ends - 1], n_turn, low, high], 1)
    whole = (np.bincount(run[at])[run[at]] == 1) & (run[at] > 0) & (run[at] < run[-1])
    want = np.where(whole, 1, 16)
    which = np.repeat(np.arange(len(at)), want)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(want) - want, want)
    closed = chart.cost[:, 0] + INSERT * np.array([len(CLOSING[q]) for q in STATES])
    last = (closed * 16 + chart.rank[:, 0]).argmin(1)
    q = np.where(whole[which], last[which], cell % 4)
    made = chart.edits(which, np.where(whole[which], 0, cell // 4), q)
    tails = [CLOSING[x] for x in last.tolist()]
    edits, n = [], 0
    for i, w in enumerate(whole.tolist()):
        edits.append([made[n] + tails[i]] if w else made[n : n + 16])
        n += 1 if w else 16
    total = closed[np.arange(len(at)), last]
    cost = [[t] if w else c for w, t, c in zip(whole.tolist(), total.tolist(), chart.cost.reshape(-1, 16).tolist())]
    rank = [[] if w else c for w, c in zip(whole.tolist(), chart.rank.reshape(-1, 16).tolist())]
    first = pa.array(at)
    return pa.record_batch(
        [
            conv.take(first), turn.take(first), held.column("digest").take(first), pa.array((np.asarray(held.column("piece"))[at] << 32) + number + np.arange(len(at))),
            pa.array(whole), pa.array(stats.tolist(), pa.list_(pa.int64())), pa.array(cost, pa.list_(pa.int64())),
            pa.array(rank, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string())),
        ],
        ["conv_id", "turn", "digest", "number", "whole", "stats", "cost", "rank", "edits"],
    )


def _blocks(symbols: DataFrame, most: int) -> DataFrame:
    """Parsed blocks of all conversations. Ranges of (conversation, turn) are parsed side by side, so a long conversation
    is spread over tasks; a task holds a block and the conversations of a batch."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("piece")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(np.asarray(batch.column(batch.schema.get_field_index("copies"))).sum())
            if size < most:
                continue
            out = _parse(pa.Table.from_batches(held).combine_chunks().to_batches()[0], number, most)
            number += out.num_rows
            held, size = [], 0
            yield out
        if held:
            yield _parse(pa.Table.from_batches(held).combine_chunks().to_batches()[0], number, most)

    ordered = symbols.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, _BLOCKS)


class _Turns:
    """Applies edits to the rows of one conversation as they come."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def _put(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put(), "", "I"

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.insertions()
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield role, text, edit
            elif edit == "R":
                yield self._put(), text, edit


def _summary(stats: list[list[int]]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated, illegal from the counts of all blocks in order."""
    s = [dict(zip(_STATS, x)) for x in stats]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum(x["illegal"] for x in s) + sum((a["last_role"], b["first_role"]) not in legal for a, b in zip(s, s[1:]))
    dated = [x for x in s if x["n_turn"]]
    distinct = sum(x["n_turn"] for x in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = max(x["high"] for x in dated) - min(x["low"] for x in dated) + 1 - distinct if dated else 0
    return gaps, *[sum(x[k] for x in s) for k in ("blank", "duplicate", "truncated")], illegal


class _Conversation:
    """What is known of the conversation that a stream is in."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.stats, self.opening = conv_id, [], Opening()
        self.cost, self.edits, self.turns, self.n = 0, "", None, 0
        self.sha = hashlib.sha256()

    def block(self, stats: list[int], whole: bool, cost: list[int], rank: list[int], edits: list[str]) -> None:
        self.stats.append(stats)
        if whole:
            self.cost, self.edits = cost[0], edits[0]
        else:
            self.opening.add(cost, rank, edits)
            self.cost = -1

    def open(self) -> _Turns:
        if self.turns is None:
            if self.cost < 0:
                self.cost, self.edits = self.opening.close()
            self.turns = _Turns(self.edits)
        return self.turns

    def put(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.n else f"{role}:{text}").encode())
        self.n += 1

    def report(self) -> tuple:
        return self.conv_id, *_summary(self.stats), self.cost, self.edits, self.sha.hexdigest()


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(rows: DataFrame, most: int) -> DataFrame:
    """Of each conversation, first its blocks in order, then its rows in order."""
    keyed = _keyed(rows)
    blocks = _blocks(_symbols(keyed, most), most)
    texts = keyed.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", F.lit(0).cast("long").alias("number"), "role", "text", "copies")
    both = blocks.select("*", F.lit(0).alias("kind")).unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "digest", "number"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "kind", "stats", "whole", "cost", "rank", "edits", "role", "text", "copies"
    )


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, place, role, text, edit`` of every turn of the repaired conversations; ``edit`` is I, K or R.

    ``rows``: conv_id, turn, role, text and possibly ``copies`` (how often a row stands there; 0: it does not). See
    :func:`repair_report` for the rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None

        def made(found: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["conv_id", "place", "role", "text", "edit"])

        for batch in batches:
            out: list[tuple] = []

            def put(turns: Iterator[tuple[str, str, str]], c: _Conversation, out: list = out) -> None:
                for role, text, edit in turns:
                    out.append((c.conv_id, c.n, role, text, edit))
                    c.n += 1

            for conv, kind, stats, whole, cost, rank, edits, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        put(now.open().insertions(), now)
                    now = _Conversation(conv)
                if kind == 0:
                    now.block(stats, whole, cost, rank, edits)
                else:
                    put(now.open().row(role, text, copies), now)
            yield made(out)
        if now is not None:
            last = [(now.conv_id, now.n + i, *x) for i, x in enumerate(now.open().insertions())]
            yield made(last)

    return _stream(rows, block).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def repair_report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``rows``.

    Rows are taken by turn, the null turn first, rows of one turn by the MD5 of role and text; null roles and texts are one
    blank; a null conv_id is a conversation of its own. A role that is empty or begins with another letter than s, u or a
    cannot be kept. Repeated rows are duplicates. Conversations whose rows all have no copies have zeros, no edits and the
    hash of the empty string; an empty table gives an empty one; other columns are ignored.

    Equal rows are counted before any shuffle and long conversations are parsed in blocks by many tasks. Texts pass through
    once; the rows of one conversation are hashed as a stream, as a hash cannot be divided, so memory holds the edits of
    one conversation but not its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None

        def end(c: _Conversation) -> tuple:
            for role, text, _ in c.open().insertions():
                c.put(role, text)
            return c.report()

        def made(done: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            names = ["conv_id", *_REPORT, "audit", "repaired_sha256"]
            return pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for conv, kind, stats, whole, cost, rank, edits, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(end(now))
                    now = _Conversation(conv)
                if kind == 0:
                    now.block(stats, whole, cost, rank, edits)
                else:
                    for new_role, new_text, _ in now.open().row(role, text, copies):
                        now.put(new_role, new_text)
            yield made(done)
        if now is not None:
            yield made([end(now)])

    schema = "conv_id long, " + "".join(f"{c} long, " for c in _REPORT) + "audit string, repaired_sha256 string"
    return _stream(rows, block).mapInArrow(run, schema)


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`repair_report` of the :func:`damaged` conversations; those that lost all rows are reported too."""
    return repair_report(damaged(conversations), block)
