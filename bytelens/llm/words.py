"""Words of a batch of texts, found and hashed by array operations on the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_P, _P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_P))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words as runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words as runs of lower-cased ASCII letters, digits and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        m = max(n, 1 << 16)
        held = np.ones(m, np.uint64)
        held[1:] = _U(base)
        _powers[name] = held = np.multiply.accumulate(held)
    return held[:n]


def forget() -> None:
    _powers.clear()


@dataclass
class Words:
    """Of documents first..last-1 of the batch. ends: words before each document and after the last."""

    first: int
    last: int
    ends: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray
    total: np.ndarray

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word, of the whole where it is shorter."""
        stop = np.minimum(self.start + size, self.stop)
        h = (self.total[stop] - self.total[self.start]) * _power("down", _P_INVERSE, len(self.total))[self.start]
        return mix(h + (stop - self.start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def of(self, k: int) -> slice:
        return slice(int(self.ends[k]), int(self.ends[k + 1]))


def words(texts: pa.Array, kind: np.ndarray, most: int = 2_000_000) -> Iterator[Words]:
    """In slices of about ``most`` bytes; ASCII letters count as lower case. Null is empty."""
    from bytelens.llm.tokens import slices

    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    for a, b in slices(np.maximum(np.diff(off), 1), most):
        data = _LOWER[raw[off[a] : off[b]]]
        at = off[a : b + 1] - off[a]
        inside = kind[data]
        n = len(data)
        # A word starts inside where the byte before isn't, or where a document starts.
        begin = inside.copy()
        end = inside.copy()
        if n:
            cut = np.zeros(n + 1, bool)
            cut[at] = True
            begin[1:] &= ~inside[:-1] | cut[1:n]
            end[:-1] &= ~inside[1:] | cut[1:n]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", _P, n), out=total[1:])
        h = (total[stop] - total[start]) * _power("down", _P_INVERSE, n + 1)[start]
        h = mix(h + (stop - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        yield Words(a, b, np.searchsorted(start, at), h, start, stop, data, total)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a lower-case word."""
    return int(next(words(pa.array([word]), np.ones(256, bool))).hash[0])


def shingles(w: Words, k: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of document k; the whole of fewer words as one; none of none."""
    h = w.hash[w.of(k)]
    n = len(h)
    if n == 0:
        return h
    m = min(n, size)
    out = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        out = out * _U(0xC2B2AE3D27D4EB4F) + h[j : n - m + 1 + j]
    return np.unique(mix(out + _U(m)))
