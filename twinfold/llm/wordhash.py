"""Vectorised word and shingle hashes over many texts at once.

Words are maximal runs of bytes other than the six ASCII white-space bytes. A
word's 64-bit hash is a polynomial in an odd base over random byte values,
modulo 2**64, taken from prefix sums and then mixed, so a buffer of many texts
is hashed in a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = b" \t\n\r\x0b\x0c"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is far faster than ``np.unique`` is here."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


#: Masks of the first 0 to 8 bytes of a little-endian integer.
_MASK = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    ahead = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead), np.cumprod(back)


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; one longer text is a range of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, about ``CHUNK`` bytes at a time, so that one very long text needs no more memory than many."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = int(np.searchsorted(start, base + CHUNK))
        own = buf[base : int(end[hi - 1])]
        ahead, back = powers(1 << max(CHUNK.bit_length(), len(own).bit_length()))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * ahead[: len(own)], out=sums[1:])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((sums[b] - sums[a]) * back[a])
        lo = hi
    return out


def _pairs() -> np.ndarray:
    """Which two bytes are a letter of the Latin supplements that is stable under NFC and lower-cases one to one."""
    out = np.zeros(1 << 16, bool)
    for c in range(0xC0, 0x17F):
        if c not in (0xD7, 0xF7, 0x130, 0x149):
            first, second = chr(c).encode()
            out[first << 8 | second] = True
    return out


_LATIN = _pairs()
#: 0: not plain, 1: letter or part of one, 2: digit, 3: mark; an apostrophe can begin an ending such as 's and isn't plain.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0


class Runs:
    """Runs of several texts: a word of plain characters gives its runs of letters,
    of digits and of marks, any other word is one run. ``start`` and ``end`` (bytes
    in ``data``), ``at`` (where texts begin), ``first`` (index of each text's first run, and the end).
    With ``whole`` every word is one run."""

    def __init__(self, texts: list[bytes], joint: bytes = b"\n", whole: bool = False):
        self.data = joint.join(texts) + joint
        self.buf = np.frombuffer(self.data + bytes(8), np.uint8)
        buf = self.buf[:-8]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        space = _IS_SPACE[buf]
        edge = np.empty(len(buf) + 1, bool)
        edge[0], edge[-1] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        bounds = np.flatnonzero(edge)
        self.start, self.end = bounds[0::2], bounds[1::2]
        if not whole:
            self._cut(buf, space)
        self.first = np.searchsorted(self.start, self.at)
        # eight bytes from each place on
        self.eight = np.ndarray((len(self.data) + 1,), "<u8", self.buf, strides=(1,))

    def _cut(self, buf: np.ndarray, space: np.ndarray) -> None:
        words = self.start
        kind = _KIND[buf]
        high = np.flatnonzero(buf >= 0x80)
        if len(high):
            plain = _LATIN[buf[high].astype(np.int32) << 8 | self.buf[high + 1]]
            kind[high[plain]] = kind[high[plain] + 1] = 1
        # inside a word with anything that isn't plain there are no edges
        odd = np.flatnonzero((kind == 0) & ~space)
        broken = np.unique(np.searchsorted(words, odd, side="right") - 1)
        change = np.flatnonzero((kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1]) + 1
        if len(broken):
            change = change[~np.isin(np.searchsorted(words, change, side="right") - 1, broken)]
        self.start, self.end = np.sort(np.concatenate([words, change])), np.sort(np.concatenate([self.end, change]))

    def lone_space(self) -> np.ndarray:
        """Whether each run follows a space."""
        return (self.buf[np.maximum(self.start - 1, 0)] == 32) & (self.start > 0)

    def different(self) -> tuple[list[bytes], np.ndarray]:
        """The different words, and each word's index among them."""
        key, check = self.keys(np.uint64(0))
        key, one, again = np.unique(key, return_index=True, return_inverse=True)
        if (check[one][again] != check).any():  # two words of one hash
            index: dict[bytes, int] = {}
            again = np.asarray([index.setdefault(self.data[a:b], len(index)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])
            return list(index), again
        return [self.data[a:b] for a, b in zip(self.start[one].tolist(), self.end[one].tolist(), strict=True)], again

    def keys(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each run, its length and ``lead``."""
        left = self.end - self.start
        one = (left.astype(np.uint64) * np.uint64(2) + lead) * np.uint64(_BASE)
        two = ~one
        some, k = None, 0
        while len(left):
            here = self.start if some is None else self.start[some] + k
            eight = self.eight[here] & _MASK[np.minimum(left, 8)]
            if some is None:
                one, two = mix((one ^ eight) * np.uint64(_BASE)), mix((two ^ eight) * np.uint64(_OTHER))
            else:
                one[some], two[some] = mix((one[some] ^ eight) * np.uint64(_BASE)), mix((two[some] ^ eight) * np.uint64(_OTHER))
            more = np.flatnonzero(left > 8)
            some = more if some is None else some[more]
            left, k = left[more] - 8, k + 8
        return one, two


class Words:
    """Words of several texts: ``doc`` (index of the text), ``hash``, ``start`` and ``end`` (bytes in the joined buffer), ``first`` (index of each text's first word, and the end)."""

    def __init__(self, texts: list[bytes], joint: bytes = b"\n"):
        data = joint.join(texts) + joint
        buf = np.frombuffer(data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        gap = np.concatenate([[True], _IS_SPACE[buf], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.buf, self.start, self.end = data, edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = _hashes(buf, self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words at which ``n`` words of one text begin, and the hashes of those."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(count, np.uint64)
        for j in range(n):
            total = total * np.uint64(_BASE) + self.hash[j : j + count]
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[:count])
        return at, mix(total[at])
