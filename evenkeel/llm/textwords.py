"""Words of many texts at once: places and 64-bit hashes, by whole-array operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
#: Odd, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first n powers of ``base`` modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (finaliser of a well-known hash)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


class Rolling:
    """Polynomial hashes of ranges of a sequence: equal ranges hash alike wherever they stand.

    Modulo 2^64, strings built for it (from about 1,024 symbols on) can collide; other different ranges do so by chance only.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values.astype(U) * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, INVERSE)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + U(1) * (stop - start).astype(U))


class Words:
    """The words of some texts: ``starts`` and ``stops`` in ``data`` (lower-cased), ``first`` word of each text (with
    the end), ``hashes``. ``is_word`` says for each byte whether it belongs to words; a line feed must not."""

    def __init__(self, texts: Sequence[str | bytes | None], is_word: np.ndarray):
        encoded = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        joined = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        lower = joined + np.uint8(32) * ((joined >= 65) & (joined <= 90)).astype(np.uint8)
        inside = np.zeros(len(lower) + 1, np.int8)
        inside[1:] = is_word[lower]
        step = np.diff(inside)
        self.starts, self.stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        bounds = np.cumsum([0, *[len(e) + 1 for e in encoded]])
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = Rolling(lower).of(self.starts, self.stops)
        self.data = lower.tobytes()

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, start: int, stop: int) -> bytes:
        """Words start to stop, with one blank between."""
        return b" ".join([self.data[a:b] for a, b in zip(self.starts[start:stop].tolist(), self.stops[start:stop].tolist())])


def byte_set(pieces: Sequence[tuple[int, int]]) -> np.ndarray:
    """A table of all bytes that are true in the given inclusive ranges."""
    out = np.zeros(256, np.int8)
    for a, b in pieces:
        out[a : b + 1] = 1
    return out


#: Letters and digits: all but 00-2F, 3A-60 and 7B-7F, once A-Z are in lower case.
ALPHANUMERIC = byte_set([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: All but white space.
VISIBLE = 1 - byte_set([(0x20, 0x20), (0x09, 0x0D)])
