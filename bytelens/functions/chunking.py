"""Content-defined chunks by a Gear rolling hash."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np

from bytelens.functions import lockstep
from bytelens.functions.hashes import MASK, mix_word


@cache
def gear_table() -> tuple[int, ...]:
    out, state = [], 0x9E3779B97F4A7C15
    for i in range(256):
        state = mix_word((state + i) & MASK)
        out.append(state)
    return tuple(out)


def gear_update(h: int, x: int) -> int:
    return ((h << 1 & MASK | h >> 63) + gear_table()[x]) & MASK


def gear_hash(raw: bytes, initial: int = 0) -> int:
    for x in raw:
        initial = gear_update(initial, x)
    return initial


@dataclass(frozen=True)
class ChunkSizes:
    """level > 0: a stricter cut before the average size and a looser one after it."""

    min_size: int
    avg_size: int
    max_size: int
    level: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.min_size <= self.avg_size <= self.max_size:
            raise ValueError("sizes must rise from min to avg to max")

    @classmethod
    def around(cls, avg: int, level: int = 0) -> ChunkSizes:
        avg = 1 << (max(64, avg) - 1).bit_length()
        return cls(max(16, avg // 4), avg, 4 * avg, min(level, 8))

    def masks(self) -> tuple[int, int]:
        bits = (max(1, self.avg_size) - 1).bit_length()
        strict, loose = bits + self.level, max(0, bits - self.level)
        return (1 << min(strict, 64)) - 1, (1 << loose) - 1


def gear_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash after every byte of payloads that begin at ``at``; it doesn't start anew at a cut."""
    table = np.array(gear_table(), np.uint64)
    step = lambda h, x: ((h << np.uint64(1)) | (h >> np.uint64(63))) + table[x]
    one = lambda h, xs: list(accumulate(xs, gear_update, initial=h))[1:]
    return lockstep.fold(raw, at, 0, np.uint64, step, one, every=True)


def cuts(h: np.ndarray, sizes: ChunkSizes) -> list[int]:
    """Ends of the chunks of one payload with these hashes."""
    strict, loose = sizes.masks()
    early = np.flatnonzero((h & np.uint64(strict)) == 0)
    late = np.flatnonzero((h & np.uint64(loose)) == 0) if sizes.level else early
    normal = sizes.avg_size if sizes.level else sizes.max_size
    out, start, n = [], 0, len(h)
    while start < n:
        end = min(n, start + sizes.max_size)
        # A cut is looked for from the least size on: under the strict mask up to the normal size, then under the loose.
        for places, lo, hi in ((early, start + sizes.min_size, start + normal), (late, start + max(normal, sizes.min_size), end)):
            k = np.searchsorted(places, lo)
            if k < len(places) and places[k] < min(hi, end):
                end = int(places[k]) + 1
                break
        out.append(end)
        start = end
    return out


def chunks(raw: bytes, sizes: ChunkSizes) -> list[tuple[int, int, int]]:
    """(start, end, hash at the end)."""
    h = gear_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ends = cuts(h, sizes)
    return [(a, b, int(h[b - 1])) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def first_cut(raw: bytes, sizes: ChunkSizes) -> int:
    """Length of the first chunk; 0 of an empty payload."""
    return next((b for _, b, _ in chunks(raw[: sizes.max_size], sizes)), 0)


class OpenChunks:
    """The chunks of a payload that comes in pieces: cuts are those of the whole, given out as soon as they are sure.

    Between pieces it holds three numbers: the hash, how many bytes have come and where the open chunk begins.
    """

    def __init__(self, sizes: ChunkSizes, h: int = 0, read: int = 0, start: int = 0):
        self.sizes, self.h, self.read, self.start = sizes, h, read, start

    def feed(self, piece: bytes) -> list[tuple[int, int, int]]:
        """(start, end, hash at the end) of the chunks that end in this piece."""
        if not piece:
            return []
        hs = np.fromiter(accumulate(piece, gear_update, initial=self.h), np.uint64, len(piece) + 1)[1:]
        strict, loose = self.sizes.masks()
        early = np.flatnonzero((hs & np.uint64(strict)) == 0) + self.read
        late = np.flatnonzero((hs & np.uint64(loose)) == 0) + self.read if self.sizes.level else early
        normal = self.sizes.avg_size if self.sizes.level else self.sizes.max_size
        out, begin = [], self.read
        self.read, self.h = self.read + len(piece), int(hs[-1])
        while True:
            full = self.start + self.sizes.max_size
            end = full
            for places, lo, hi in ((early, self.start + self.sizes.min_size, self.start + normal), (late, self.start + max(normal, self.sizes.min_size), full)):
                k = np.searchsorted(places, lo)
                if k < len(places) and places[k] < min(hi, full):
                    end = int(places[k]) + 1
                    break
            if end > self.read:
                return out
            out.append((self.start, end, int(hs[end - 1 - begin])))
            self.start = end

    def close(self) -> list[tuple[int, int, int]]:
        """The last chunk, once the payload has ended."""
        return [(self.start, self.read, self.h)] if self.start < self.read else []
