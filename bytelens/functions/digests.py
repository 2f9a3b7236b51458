"""Digests whose state can be kept between pieces of a payload: SHA-256 and BLAKE3.

A state takes pieces of any length, gives the digest of what has come so far, and goes into bytes and back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import isqrt

from bytelens.functions import hashes

_M32 = 0xFFFFFFFF


def _primes(n: int) -> Iterator[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
            yield k
        k += 1


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid - 1)
    return lo


# Fixed values of SHA-256, by their rule: fractions of the square and cube roots of the first primes.
_START = [isqrt(p << 64) & _M32 for p in _primes(8)]
_ROUNDS = [_cube_root(p << 96) & _M32 for p in _primes(64)]


def _turn(x: int, n: int) -> int:
    return (x >> n | x << 32 - n) & _M32


class Sha256:
    """SHA-256 of pieces."""

    def __init__(self) -> None:
        self.h, self.n, self.rest = list(_START), 0, b""

    def _block(self, block: bytes) -> None:
        w = list(struct.unpack(">16I", block))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> 3) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10)) & _M32)
        a, b, c, d, e, f, g, h = self.h
        for k, x in zip(_ROUNDS, w, strict=True):
            t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + k + x
            u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (t + u) & _M32, a, b, c, (d + t) & _M32, e, f, g
        self.h = [(x + y) & _M32 for x, y in zip(self.h, (a, b, c, d, e, f, g, h), strict=True)]

    def update(self, piece: bytes) -> None:
        self.n += len(piece)
        data = self.rest + piece
        whole = len(data) // 64 * 64
        for i in range(0, whole, 64):
            self._block(data[i : i + 64])
        self.rest = data[whole:]

    def digest(self) -> bytes:
        end = Sha256.load(self.dump())
        pad = b"\x80" + bytes(-(self.n + 9) % 64) + struct.pack(">Q", 8 * self.n)
        end.update(pad)
        return struct.pack(">8I", *end.h)

    def dump(self) -> bytes:
        return struct.pack("<8IQ", *self.h, self.n) + self.rest

    @classmethod
    def load(cls, raw: bytes) -> Sha256:
        out = cls()
        *out.h, out.n = struct.unpack("<8IQ", raw[:40])
        out.rest = raw[40:]
        return out


class Blake3:
    """BLAKE3 of pieces: the open chunk, and a chaining value for each complete subtree to its left."""

    def __init__(self) -> None:
        self.stack: list[list[int]] = []
        self.chunks, self.blocks, self.cv, self.rest = 0, 0, hashes._IV.tolist(), b""

    def _node(self, block: bytes, last: bool) -> tuple:
        flags = (hashes._START if self.blocks == 0 else 0) | (hashes._END if last else 0)
        return self.cv, hashes._words(block), self.chunks, len(block), flags

    def update(self, piece: bytes) -> None:
        data, i = self.rest + piece, 0
        while len(data) - i > 64:  # the last block stays open: it may be the last of all
            block = data[i : i + 64]
            i += 64
            if self.blocks == 15:
                cv = hashes._compress(*self._node(block, True))[:8]
                self.chunks += 1
                joined = self.chunks
                while joined % 2 == 0:
                    cv = hashes._compress(hashes._IV.tolist(), self.stack.pop() + cv, 0, 64, hashes._PARENT)[:8]
                    joined //= 2
                self.stack.append(cv)
                self.blocks, self.cv = 0, hashes._IV.tolist()
            else:
                self.cv = hashes._compress(*self._node(block, False))[:8]
                self.blocks += 1
        self.rest = data[i:]

    def digest(self) -> bytes:
        node = self._node(self.rest, True)
        for left in reversed(self.stack):
            node = (hashes._IV.tolist(), left + hashes._compress(*node)[:8], 0, 64, hashes._PARENT)
        cv, block, _, length, flags = node
        return struct.pack("<8I", *hashes._compress(cv, block, 0, length, flags | hashes._ROOT)[:8])

    def dump(self) -> bytes:
        flat = [x for cv in self.stack for x in cv]
        return struct.pack(f"<QBB8I{len(flat)}I", self.chunks, self.blocks, len(self.stack), *self.cv, *flat) + self.rest

    @classmethod
    def load(cls, raw: bytes) -> Blake3:
        out = cls()
        out.chunks, out.blocks, n = struct.unpack("<QBB", raw[:10])
        values = list(struct.unpack(f"<{8 * (n + 1)}I", raw[10 : 10 + 32 * (n + 1)]))
        out.cv, out.stack = values[:8], [values[8 * k : 8 * k + 8] for k in range(1, n + 1)]
        out.rest = raw[10 + 32 * (n + 1) :]
        return out


DIGESTS = {"sha256": Sha256, "blake3": Blake3}
