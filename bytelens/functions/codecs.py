"""Integer codecs, compressed sets and rank/select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def bit_pack(values: np.ndarray, width: int) -> bytes:
    """Lowest bits first, contiguous; higher bits of a value are dropped."""
    if not 1 <= width <= 32:
        raise ValueError("width must be from 1 to 32")
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def bit_unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=width * n).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.uint64)


def stream_vbyte(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): of each value its bytes less one, two bits, and those bytes."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    each = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4)[None] < size[:, None]].tobytes()


def stream_vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(control, np.uint8)
    size = ((c[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n].astype(np.int64) + 1
    if size.sum() > len(data):
        raise ValueError("data is cut off")
    each = np.zeros((n, 4), np.uint8)
    each[np.arange(4)[None] < size[:, None]] = np.frombuffer(data, np.uint8, int(size.sum()))
    return each.reshape(-1).view("<u4").copy()


def delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0)) if len(values) else values


def undelta(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps)


@dataclass(frozen=True)
class Container:
    """A set of 16-bit numbers: sorted array up to 4,096 of them, else bitmap; runs where asked for."""

    kind: str
    values: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Container:
        v = np.unique(values.astype(np.uint16))
        return cls("array" if len(v) <= 4096 else "bitmap", v)

    @classmethod
    def checked(cls, values: np.ndarray) -> Container | None:
        """None unless strictly ascending and within 16 bits."""
        v = np.asarray(values)
        return cls.of(v) if len(v) == 0 or (v.min() >= 0 and v.max() < 65536 and (np.diff(v) > 0).all()) else None

    def runs(self) -> list[tuple[int, int]]:
        """(start, length less one) of each stretch."""
        if not len(self.values):
            return []
        cut = np.flatnonzero(np.diff(self.values.astype(int)) > 1)
        a, b = np.r_[0, cut + 1], np.r_[cut, len(self.values) - 1]
        return [(int(self.values[i]), int(self.values[j]) - int(self.values[i])) for i, j in zip(a, b, strict=True)]

    def words(self) -> np.ndarray:
        bits = np.zeros(65536, np.uint8)
        bits[self.values] = 1
        return np.packbits(bits, bitorder="little").view("<u8")

    def __len__(self) -> int:
        return len(self.values)

    def __contains__(self, x: int) -> bool:
        i = np.searchsorted(self.values, x)
        return bool(i < len(self.values) and self.values[i] == x)

    def __and__(self, o: Container) -> Container:
        return Container.of(np.intersect1d(self.values, o.values, assume_unique=True))

    def __or__(self, o: Container) -> Container:
        return Container.of(np.union1d(self.values, o.values))

    def __sub__(self, o: Container) -> Container:
        return Container.of(np.setdiff1d(self.values, o.values, assume_unique=True))

    def __xor__(self, o: Container) -> Container:
        return Container.of(np.setxor1d(self.values, o.values, assume_unique=True))


class RankSelect:
    """Over bits: ones before a place, and the place of the k-th one or zero."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.before = np.r_[0, np.cumsum(self.bits)]
        self.ones, self.zeros = np.flatnonzero(self.bits), np.flatnonzero(~self.bits)

    def rank1(self, i: int) -> int | None:
        return int(self.before[i]) if 0 <= i <= len(self.bits) else None

    def rank0(self, i: int) -> int | None:
        return i - int(self.before[i]) if 0 <= i <= len(self.bits) else None

    def select1(self, k: int) -> int | None:
        return int(self.ones[k]) if 0 <= k < len(self.ones) else None

    def select0(self, k: int) -> int | None:
        return int(self.zeros[k]) if 0 <= k < len(self.zeros) else None


def popcount(words: np.ndarray) -> int:
    return int(np.bitwise_count(words.astype(np.uint64)).sum())
