"""Sketches with fixed definitions. State is plain numpy or Python and merges where a merge is defined."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

from bytelens.functions.hashes import MASK, mix64, mix64_all, mix_words
from bytelens.functions.payload import crc32c_words


class SpaceSaving:
    """k counters; a new item takes the least one, whose count it goes on from. Counts are never too low."""

    def __init__(self, k: int):
        self.k, self.items, self.counts, self.errors, self.place = k, [], [], [], {}

    def update(self, item: int, count: int = 1) -> None:
        if item in self.place:
            self.counts[self.place[item]] += count
        elif len(self.items) < self.k:
            self.place[item] = len(self.items)
            self.items.append(item), self.counts.append(count), self.errors.append(0)
        elif self.k:
            i = min(range(self.k), key=self.counts.__getitem__)
            del self.place[self.items[i]]
            self.place[item], self.items[i], self.errors[i] = i, item, self.counts[i]
            self.counts[i] += count

    def estimate(self, item: int) -> int:
        return self.counts[self.place[item]] if item in self.place else 0

    def snapshot(self) -> list[tuple[int, int]]:
        return list(zip(self.items, self.counts, strict=True))


class MisraGries:
    """k counters; where none is free, all fall by one. Counts are too low by n / (k + 1) at most."""

    def __init__(self, k: int):
        self.k, self.n, self.counts = k, 0, {}

    def update(self, item: int) -> None:
        self.n += 1
        if item in self.counts:
            self.counts[item] += 1
        elif len(self.counts) < self.k:
            self.counts[item] = 1
        else:
            self.counts = {x: c - 1 for x, c in self.counts.items() if c > 1}

    def merge(self, other: MisraGries) -> None:
        """Sum, then take off the (k + 1)-th largest count; the bound stays that of the joint n."""
        both = dict(self.counts)
        for x, c in other.counts.items():
            both[x] = both.get(x, 0) + c
        cut = sorted(both.values(), reverse=True)[self.k] if len(both) > self.k else 0
        self.n, self.counts = self.n + other.n, {x: c - cut for x, c in both.items() if c > cut}

    @property
    def error(self) -> float:
        return self.n / (self.k + 1)


def count_min_cells(items: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """(rows, n): the cell of each 32-bit item in each row."""
    seeds = [(0x9E3779B9 * (r + 1)) & 0xFFFFFFFF for r in range(rows)]
    return np.stack([crc32c_words(items, s) % np.uint32(cols) for s in seeds]).astype(np.int64)


class CountMin:
    def __init__(self, rows: int = 4, cols: int = 1024):
        self.table = np.zeros((rows, cols), np.int64)

    def update(self, items: np.ndarray, counts: np.ndarray | int = 1) -> None:
        for r, cell in enumerate(count_min_cells(items, *self.table.shape)):
            np.add.at(self.table[r], cell, counts)
        np.minimum(self.table, 0xFFFFFFFF, out=self.table)

    def estimate(self, items: np.ndarray) -> np.ndarray:
        cells = count_min_cells(items, *self.table.shape)
        return np.min([self.table[r][c] for r, c in enumerate(cells)], axis=0)

    def merge(self, other: CountMin) -> None:
        self.table = np.minimum(self.table + other.table, 0xFFFFFFFF)


HLL_SEED = 0xC8C25E0F2C5C3F6D


def hll_index_rank(h: int, p: int) -> tuple[int, int]:
    rest = h << p & MASK
    return h >> 64 - p, 64 - rest.bit_length() + 1 if rest else 64 - p + 1


class HyperLogLog:
    def __init__(self, p: int = 12):
        if not 4 <= p <= 16:
            raise ValueError("precision must be from 4 to 16")
        self.p, self.registers = p, np.zeros(1 << p, np.uint8)

    def insert(self, raw: bytes) -> None:
        self.insert_hash(mix64(raw, HLL_SEED))

    def insert_hash(self, h: int) -> None:
        i, r = hll_index_rank(h, self.p)
        self.registers[i] = max(self.registers[i], r)

    def merge(self, other: HyperLogLog) -> None:
        if self.p != other.p:
            raise ValueError("precisions differ")
        np.maximum(self.registers, other.registers, out=self.registers)

    def estimate(self) -> int:
        m = len(self.registers)
        return hll_estimate(m, float((2.0 ** -self.registers.astype(float)).sum()), int((self.registers == 0).sum()))


def hll_alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697}.get(m, 0.7213 / (1 + 1.079 / m))


def hll_estimate(m: int, inverse_sum: float, zeros: int) -> int:
    raw = hll_alpha(m) * m * m / inverse_sum
    if raw <= 2.5 * m and zeros:
        raw = m * math.log(m / zeros)
    elif raw > 2.0**32 / 30:
        raw = -(2.0**32) * math.log(1 - raw / 2.0**32) if raw < 2.0**32 else raw
    return int(raw + 0.5)


BLOOM_SEEDS = (0x9E3779B97F4A7C15, 0x6E5E2E5CDEADBEEF)


class Bloom:
    def __init__(self, bits: int, hashes: int):
        if not 1 <= hashes <= 32:
            raise ValueError("hashes must be from 1 to 32")
        self.bits = max(64, -(-bits // 64) * 64)
        self.hashes, self.n, self.words = hashes, 0, np.zeros(self.bits // 64, np.uint64)

    @classmethod
    def sized(cls, items: int, rate: float) -> Bloom:
        m = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
        return cls(m, max(1, round(m / items * math.log(2))))

    def positions(self, raw: bytes) -> np.ndarray:
        a, b = (mix64(raw, s) for s in BLOOM_SEEDS)
        return np.array([((a + i * b) & MASK) % self.bits for i in range(self.hashes)], np.uint64)

    def positions_all(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of positions of many payloads, which begin at ``at``."""
        a, b = (mix64_all(raw, at, s) for s in BLOOM_SEEDS)
        return (a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.bits)

    def insert_all(self, raw: np.ndarray, at: np.ndarray) -> None:
        p = self.positions_all(raw, at)
        np.bitwise_or.at(self.words, (p // np.uint64(64)).astype(np.int64), np.uint64(1) << p % np.uint64(64))
        self.n += len(at) - 1

    def contains_all(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = self.positions_all(raw, at)
        return (self.words[(p // np.uint64(64)).astype(np.int64)] >> p % np.uint64(64) & np.uint64(1)).all(1)

    def positions_of_keys(self, keys: np.ndarray) -> np.ndarray:
        """Rows of positions of 64-bit whole numbers, which have hashes of their own."""
        a, b = (mix_words(keys.astype(np.int64).view(np.uint64) ^ np.uint64(s)) for s in BLOOM_SEEDS)
        return (a[:, None] + np.arange(self.hashes, dtype=np.uint64) * (b | np.uint64(1))[:, None]) % np.uint64(self.bits)

    def insert_keys(self, keys: np.ndarray) -> None:
        p = self.positions_of_keys(keys)
        np.bitwise_or.at(self.words, (p // np.uint64(64)).astype(np.int64), np.uint64(1) << p % np.uint64(64))
        self.n += len(keys)

    def contains_keys(self, keys: np.ndarray) -> np.ndarray:
        p = self.positions_of_keys(keys)
        return (self.words[(p // np.uint64(64)).astype(np.int64)] >> p % np.uint64(64) & np.uint64(1)).all(1)

    def insert(self, raw: bytes) -> None:
        p = self.positions(raw)
        np.bitwise_or.at(self.words, (p // 64).astype(np.int64), np.uint64(1) << p % np.uint64(64))
        self.n += 1

    def contains(self, raw: bytes) -> bool:
        p = self.positions(raw)
        return bool((self.words[(p // 64).astype(np.int64)] >> p % np.uint64(64) & np.uint64(1)).all())

    def merge(self, other: Bloom) -> None:
        self.words |= other.words
        self.n += other.n

    def rate(self) -> float:
        return (1 - math.exp(-self.hashes * self.n / self.bits)) ** self.hashes if self.n else 0.0


class P2Quantile:
    """A quantile of a stream from five markers that move along parabolas."""

    def __init__(self, p: float):
        if not 0 < p < 1:
            raise ValueError("the quantile must be between 0 and 1")
        self.p, self.count, self.q, self.n = p, 0, [], [1, 2, 3, 4, 5]
        self.want = [1.0, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5.0]
        self.step = [0.0, p / 2, p, (1 + p) / 2, 1.0]

    def update_all(self, values: Iterable[float]) -> P2Quantile:
        for v in values:
            self.update(v)
        return self

    def update(self, x: float) -> None:
        if x is None or math.isnan(x):
            return
        self.count += 1
        if self.count <= 5:
            self.q = sorted([*self.q, x])
            return
        q, n = self.q, self.n
        q[0], q[4] = min(q[0], x), max(q[4], x)
        cell = next((k for k in range(3) if x < q[k + 1]), 3)
        for i in range(5):
            n[i] += i > cell
            self.want[i] += self.step[i]
        for i in (1, 2, 3):
            gap = self.want[i] - n[i]
            up, down = n[i + 1] - n[i], n[i] - n[i - 1]
            if (gap >= 1 and up > 1) or (gap <= -1 and down > 1):
                s = 1 if gap > 0 else -1
                bent = q[i] + s / (up + down) * ((down + s) * (q[i + 1] - q[i]) / up + (up - s) * (q[i] - q[i - 1]) / down)
                if q[i - 1] < bent < q[i + 1]:
                    q[i] = bent
                else:
                    q[i] += s * (q[i + s] - q[i]) / (n[i + s] - n[i]) if s > 0 else -(q[i - 1] - q[i]) / (n[i - 1] - n[i])
                n[i] += s

    def estimate(self) -> float:
        if not self.count:
            return math.nan
        if self.count >= 5:
            return self.q[2]
        # Of fewer values than markers: between the two that stand around the quantile's place.
        return float(np.interp(self.p * (self.count - 1), range(self.count), self.q))
