"""Byte-level BPE by prefix dynamic programming, with exact appends and local re-encoding, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.pretokens import TextEncoder, chunks


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, and which two tokens can stand side by side in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens by their bytes from the last to the first: nested tables, a token's rank at -1.
        self.backward: dict = {}
        for piece, rank in ranks.items():
            node = self.backward
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.halves: dict[int, tuple[int, int]] = {}
        for piece, rank in ranks.items():
            if len(piece) > 1:
                parts = self._merge(piece, rank)
                if len(parts) == 2:
                    self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
        self._edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merges of lower rank than ``below`` applied to the bytes of one token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens that lie at one edge while ``token`` is built, each with its bytes and the rank that ends its time."""
        known = self._edges[side].get(token)
        if known is None:
            known, part, ends = [], token, float("inf")
            while part is not None:
                known.append((self.bytes_of[part], ends))
                ends, part = part, self.halves.get(part, (None, None))[side]
            self._edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border, so that the bytes of both encode to exactly these two.

        A crossing merge of two edge tokens happens if its rank comes before either is merged away; at equal ranks the
        merge further left goes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            known = self._apart(self._edge(left, 1), self._edge(right, 0))
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _apart(self, left: list[tuple[bytes, float]], right: list[tuple[bytes, float]]) -> bool:
        get = self.ranks.get
        for y, y_ends in right:
            for x, x_ends in left:
                r = get(x + y)
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True


class PrefixEncoding:
    """The encoding of every prefix of one piece: ``last[i]`` is the last token of the first i bytes.

    Each prefix has one valid last token: a suffix that is a token and fits the last token of what is before it. So
    appended bytes extend the table, and an edit recomputes it from there until it agrees with the old one again.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, old: list[int] | None = None, shift: int = 0, settled: int = 0) -> None:
        """Fill ``last``; with an ``old`` table, stop once as many entries as a token is long agree with it."""
        v, data, last = self.vocabulary, self.data, self.last
        root, known, fits, longest, agree = v.backward, v.pairs, v.fits, v.longest, 0
        for end in range(len(last), len(data) + 1):
            node, begin, found = root, end, []
            while begin:
                node = node.get(data[begin - 1])
                if node is None:
                    break
                begin -= 1
                if -1 in node:
                    found.append((begin, node[-1]))
            for begin, token in reversed(found):
                if begin == 0:
                    break
                pair = (last[begin], token)
                ok = known.get(pair)
                if fits(*pair) if ok is None else ok:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            if old is not None and end > settled:
                agree = agree + 1 if old[end - shift] == token else 0
                if agree > longest:
                    last += old[end - shift + 1 :]
                    return

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend()

    def cut(self, stop: int) -> None:
        """Keep the first ``stop`` bytes."""
        self.data = self.data[:stop]
        del self.last[stop + 1 :]

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in the place of bytes start to stop."""
        old, self.data = self.last, self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        self._extend(old, len(data) - (stop - start), start + len(data))

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: Sequence[bytes]) -> list[list[int]]:
    """Ids of each piece. Taken in byte order, so each keeps the prefix table of the one before as far as both agree."""
    out: list = [None] * len(pieces)
    table, whole = PrefixEncoding(vocabulary), vocabulary.ranks.get
    for i in sorted(range(len(pieces)), key=pieces.__getitem__):
        piece = pieces[i]
        rank = whole(piece)
        if rank is not None:
            out[i] = [rank]
            continue
        same = 0
        for a, b in zip(table.data, piece):
            if a != b:
                break
            same += 1
        table.cut(same)
        table.append(piece[same:])
        out[i] = table.ids()
    return out


@cache
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once by each worker."""
    return Vocabulary(load_ranks(path))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, ids: bool = False) -> DataFrame:
    """``docs`` without its text, with token count and digests of the ids and of the bytes decoded from them.

    A null text is empty: no ids. ``ids`` adds the ids themselves (array of int). Every column of ``docs`` but text is
    kept; columns named like the new ones raise an error. Rows are independent: no shuffle, one worker holds one batch
    and at most CACHE_PIECES pieces. The rank file must lie at ``ranks_path`` on every machine.
    """
    keep = [c for c in docs.columns if c != "text"]
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    if set(keep) & set(new):
        raise ValueError(f"columns {sorted(set(keep) & set(new))} clash with the result")
    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, SCHEMA] + ["ids array<int>"] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(ranks_path)
        encoder = TextEncoder(lambda pieces: encode_pieces(v, pieces))
        name = [str(i) for i in range(max(v.bytes_of) + 1)]
        token = [v.bytes_of.get(i, b"") for i in range(len(name))]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in chunks(texts):
                flat, before = encoder.encode(texts[a:b])
                every, cuts = flat.tolist(), before.tolist()
                own = [every[i:j] for i, j in zip(cuts, cuts[1:])]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(" ".join([name[i] for i in x]).encode()).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(b"".join([token[i] for i in x])).hexdigest() for x in own]),
                ]
                if ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                yield pa.record_batch(columns, [*keep, *new])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(*[docs[c] for c in keep], text).mapInArrow(run, schema)


def decode(vocabulary: Vocabulary, ids: Sequence[int]) -> bytes:
    return b"".join([vocabulary.bytes_of[i] for i in ids])
