"""Vectorised pre-tokenisation of byte-level BPE, and the encoding of whole texts by their distinct pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at once, unless one text alone is longer.
CHUNK_CHARS = 1_500_000
#: Pieces kept with their ids by each worker; the table starts anew beyond that.
CACHE_PIECES = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    at = lambda i: i if i < 0xD800 else i + 0x800
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[at(m.start()) : at(m.end() - 1) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` characters together, or one text."""
    first = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > most and i > first:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def text_parts(batch: pa.RecordBatch, column: int, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes of text, or of one text; no text of another part becomes a Python object."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size + n > most and i > first:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def split(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, the byte offsets of their pieces (with the end), and the pieces before each text.

    Equals matching the pattern of contractions, `` ?\\p{L}+``, `` ?\\p{N}+``, `` ?[^\\s\\p{L}\\p{N}]+``, ``\\s+(?!\\S)``
    and ``\\s+`` against each text.
    """
    joined = "".join(texts)
    data = joined.encode()
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n = len(code)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    if n == 0:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = _classes()[code]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[0] = fresh[n] = True
    fresh[ends] = True
    start = np.empty(n + 1, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= fresh
    # the last white space before other text stands alone, or belongs to what follows if it is a blank
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])
    start[last] = True
    blank = last[code[last] == 32] + 1
    start[blank] = False
    # contractions
    quote = np.flatnonzero((code[: n - 1] == 39) & start[: n - 1] & (kind[1:] == LETTER) & ~fresh[1:n])
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        letter = lambda c: ord(c)
        short = np.isin(one, [letter(c) for c in "stmd"])
        long = ((two == letter("e")) & np.isin(one, [letter("r"), letter("v")])) | ((one == letter("l")) & (two == letter("l")))
        took = quote + 1 + short + 2 * (long & ~short)
        hit = short | long
        start[quote[hit] + 1] = False
        start[took[hit]] = True
    at = np.flatnonzero(start)
    before = np.searchsorted(at, np.concatenate(([0], ends)))
    if len(data) != n:
        width = np.ones(n, np.uint8)
        for bound in (0x80, 0x800, 0x10000):
            width += code >= bound
        place = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=place[1:])
        at = place[at]
    return data, at, before


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(data: bytes, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different pieces and, for each piece, the index of its own. Exact: equal hashes are compared."""
    import xxhash

    starts, sizes = at[:-1], np.diff(at)
    if not len(starts):
        return [], np.zeros(0, np.int64)
    words = np.ndarray((len(data) + 1,), "<u8", data + bytes(24), strides=(1,))
    low = words[starts] & _MASK[np.minimum(sizes, 8)]
    high = np.ndarray((len(data) + 9,), "<u8", data + bytes(24), strides=(1,))[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
    for i in np.flatnonzero(sizes > 16):  # few: their 128-bit hash stands for them
        h = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + sizes[i]])
        low[i], high[i] = h & (2**64 - 1), h >> 64
    size = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= (high ^ (key >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + size
    n = len(starts)
    bits = max(10, min(22, int(n).bit_length()))
    own = np.empty(n, np.int64)
    todo = np.arange(n)
    seat = np.zeros(1 << bits, np.int64)
    while len(todo):  # in each round, one piece takes a seat of a table and all equal to it are settled
        with np.errstate(over="ignore"):
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
            at_seat = ((key ^ (key >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int64)
        seat[at_seat] = todo
        holder = seat[at_seat]
        same = (low[holder] == low[todo]) & (high[holder] == high[todo]) & (size[holder] == size[todo])
        own[todo[same]] = holder[same]
        todo, key = todo[~same], key[~same]
    first = np.flatnonzero(own == np.arange(n))
    number = np.empty(n, np.int64)
    number[first] = np.arange(len(first))
    return [data[a:b] for a, b in zip(starts[first].tolist(), (starts + sizes)[first].tolist())], number[own]


class TextEncoder:
    """Ids of whole texts; ``encode_new`` gives the ids of pieces not met before."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[Sequence[int]]]):
        self.encode_new = encode_new
        self.known: dict[bytes, Sequence[int]] = {}

    def _ids(self, pieces: list[bytes]) -> list[Sequence[int]]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        get = self.known.get
        found = [get(p) for p in pieces]
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.encode_new([pieces[i] for i in new]), strict=True):
            found[i] = self.known[pieces[i]] = ids
        return found

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids before each text (with the end)."""
        data, at, before = split(texts)
        pieces, own = distinct(data, at)
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        found = self._ids(pieces)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))
        offset = np.cumsum(count) - count
        each = count[own]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(offset[own] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[before]
