"""MinHash, SimHash and fuzzy digests with fixed definitions."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from bytelens.functions.hashes import mix64, mix_word, mix_words

_U = np.uint64
FULL = 0xFFFFFFFFFFFFFFFF


def mix_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix_words(a ^ mix_words(b + _U(0x9E3779B97F4A7C15)))


# MinHash: slots are uint64 with a mask of those that are populated ------------------------------


def minhash(elements: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = (np.uint64(seed) + np.arange(k, dtype=np.uint64)).astype(np.uint64)
    slots = np.full(k, FULL, np.uint64)
    for i in range(0, len(elements), 4096):
        part = elements[i : i + 4096].astype(np.uint64)
        slots = np.minimum(slots, mix_two(part[:, None], seeds[None]).min(0))
    return slots, np.full(k, len(elements) > 0)


def minhash_items(items: list[bytes], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return minhash(np.array([mix64(x, seed) for x in items], np.uint64), k, seed)


def byte_table(seeds: np.ndarray) -> np.ndarray:
    """(256, k) of a byte and a seed."""
    return mix_words(np.arange(256, dtype=np.uint64)[:, None] ^ seeds[None].astype(np.uint64))


def minhash_bytes(b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the distinct bytes of a payload."""
    k = table.shape[1]
    return (table[np.unique(b)].min(0), np.ones(k, bool)) if len(b) else (np.full(k, FULL, np.uint64), np.zeros(k, bool))


def one_permutation(elements: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    slots, there = np.full(k, FULL, np.uint64), np.zeros(k, bool)
    if len(elements):
        h = mix_two(elements.astype(np.uint64), np.full(len(elements), seed, np.uint64))
        bucket = (h % _U(k)).astype(np.int64)
        r = (bucket & 63).astype(np.uint64)
        score = (h >> r) | (h << (_U(64) - r) % _U(64))
        np.minimum.at(slots, bucket, score)
        there = slots < _U(FULL)
    return slots, there


def densify(slots: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An empty slot takes the next populated one to the right, around the end; one filled just before counts."""
    if not there.any():
        return slots, there
    at = np.flatnonzero(there)
    source = at[np.searchsorted(at, np.arange(len(slots))) % len(at)]
    return slots[source], np.ones(len(slots), bool)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    either = a[1] | b[1]
    return float((a[0] == b[0])[either].mean()) if either.any() else 0.0


def b_bit(slots: np.ndarray, bits: int) -> np.ndarray:
    return slots & _U((1 << bits) - 1) if bits < 64 else slots


def b_bit_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bits: int) -> float:
    chance = 2.0 ** -min(max(bits, 1), 63)
    return min(1.0, max(0.0, (jaccard(a, b) - chance) / (1 - chance)))


def band_keys(slots: np.ndarray, bands: int) -> np.ndarray:
    rows = len(slots) // bands
    acc = np.full(bands, 0xCBF29CE484222325, np.uint64)
    for j in range(rows):
        acc = mix_words(acc * _U(0x100000001B3) ^ slots.reshape(bands, rows)[:, j])
    return acc


def simhash(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    w = np.ones(len(hashes), np.int64) if weights is None else weights.astype(np.int64)
    out = 0
    for bit in range(64):
        side = (hashes >> _U(bit) & _U(1)).astype(np.int64) * 2 - 1
        out |= int((side * w).sum() > 0) << bit
    return out


def simhash_bytes(b: np.ndarray, seeds: np.ndarray) -> int:
    """Each byte votes on bit i by the lowest bit of its mix with seed i; only the histogram matters."""
    vote = (byte_table(seeds) & _U(1)).astype(np.int64) * 2 - 1
    total = np.bincount(b, minlength=256) @ vote
    return sum(1 << i for i, x in enumerate(total.tolist()) if x > 0)


def hamming(a: int, b: int) -> int:
    return ((a ^ b) & FULL).bit_count()


def simhash_cosine(a: int, b: int) -> float:
    return math.cos(math.pi * hamming(a, b) / 64)


def simhash_bands(bits: int, bands: int) -> list[int]:
    width = 64 // bands
    return [(bits & FULL) >> i * width & ((1 << width) - 1) for i in range(bands)]


# Piecewise hash of context-triggered pieces ------------------------------------------------------

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_M = 0xFFFFFFFF


def _rolling(b: np.ndarray) -> np.ndarray:
    """Of each place, over the seven bytes up to it: their sum, their sum weighted by age, and a shift-xor of them."""
    n = len(b)
    x = np.r_[np.zeros(7, np.uint64), b.astype(np.uint64)]
    h1 = sum(x[7 - k : 7 - k + n] for k in range(7))
    h2 = sum(x[7 - k : 7 - k + n] * _U(7 - k) for k in range(7))
    h3 = np.zeros(n, np.uint64)
    for k in range(7):
        h3 ^= x[7 - k : 7 - k + n] << _U(5 * k)
    return (h1 + h2 + (h3 & _U(_M))) & _U(_M)


def _fnv32(part: bytes) -> int:
    h = 0x811C9DC5
    for x in part:
        h = (h ^ x) * 0x01000193 & _M
    return h


def _pieces(raw: bytes, ends: list[int], most: int) -> tuple[str, int]:
    """Characters of the pieces that end at the first ``most`` places, and where the rest begins."""
    out, a = [], 0
    for e in ends[:most]:
        out.append(B64[_fnv32(raw[a:e]) & 63])
        a = e
    return "".join(out), a


def ctph(raw: bytes) -> tuple[int, str, str]:
    """(block size, body, body of twice the block size), each of 64 characters at most."""
    b = np.frombuffer(raw, np.uint8)
    size = 3
    while size * 64 < len(raw):
        size *= 2
    h = _rolling(b) + _U(1)
    while True:
        ends = (np.flatnonzero(h % _U(size) == 0) + 1).tolist()
        if len(ends) < 64 or size >= _M // 4:
            break
        size *= 2
    body, a = _pieces(raw, ends, 64)
    if len(body) < 64 and raw:
        body += B64[_fnv32(raw[a:]) & 63]
    twice, a = _pieces(raw, (np.flatnonzero(h % _U(2 * size) == 0) + 1).tolist(), 63)
    if raw:
        twice += B64[_fnv32(raw[a:]) & 63]
    return size, body, twice


def _edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _alike(a: str, b: str, size: int) -> int:
    if not a or not b:
        return 100 if a == b else 0
    if min(len(a), len(b)) >= 7 and not {a[i : i + 7] for i in range(len(a) - 6)} & {b[i : i + 7] for i in range(len(b) - 6)}:
        return 0
    total = len(a) + len(b)
    raw = max(0, 100 - 100 * _edit(a, b) // total)
    return raw if size <= 192 else min(raw, raw * 192 // size)


def ctph_similarity(a: tuple[int, str, str], b: tuple[int, str, str]) -> int:
    if a[0] == b[0]:
        return max(_alike(a[1], b[1], a[0]), _alike(a[2], b[2], 2 * a[0]))
    if a[0] == 2 * b[0]:
        return _alike(a[1], b[2], a[0])
    return _alike(a[2], b[1], b[0]) if b[0] == 2 * a[0] else 0


# Digest of bucket quartiles ----------------------------------------------------------------------

# Salts of the six triplets of a window, and which of its bytes (newest is 4) each takes.
TRIPLETS = ((49, 4, 3, 2), (12, 4, 3, 1), (178, 4, 2, 1), (166, 4, 2, 0), (84, 4, 3, 0), (230, 4, 1, 0))


@cache
def _permutation() -> np.ndarray:
    state, t = 0xC8C25E0F2C5C3F6D, list(range(256))
    for i in range(255, 0, -1):
        state ^= state << 13 & FULL
        state ^= state >> 7
        state ^= state << 17 & FULL
        j = state % (i + 1)
        t[i], t[j] = t[j], t[i]
    return np.array(t, np.uint8)


def quartile_digest(raw: bytes) -> bytes | None:
    """35 bytes; None for fewer than 50 bytes or for too few filled buckets."""
    if len(raw) < 50:
        return None
    t, b = _permutation(), np.frombuffer(raw, np.uint8)
    n = len(b) - 4
    w = [b[k : k + n] for k in range(5)]
    counts = np.zeros(256, np.int64)
    for salt, i, j, k in TRIPLETS:
        counts += np.bincount(t[t[t[w[i] ^ np.uint8(salt)] ^ w[j]] ^ w[k]], minlength=256)
    check, lead = 0, t[t[w[4] ^ np.uint8(1)] ^ w[3]].tolist()
    table = t.tolist()
    for x in lead:
        check = table[x ^ check]
    counts = counts[:128]
    q = np.sort(counts)[[31, 63, 95]]
    if q[2] == 0:
        return None
    code = (counts[:, None] > q[None]).sum(1)
    body = (code.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(1)[::-1].astype(np.uint8)
    length = min(255, int(math.log(len(raw)) / math.log(1.5)))
    ratio = int(q[0] * 100 // q[2] % 16) << 4 | int(q[1] * 100 // q[2] % 16)
    return bytes((x & 15) << 4 | x >> 4 for x in (check, length, ratio)) + body.tobytes()


def quartile_distance(a: bytes | None, b: bytes | None) -> int:
    """0 for equal digests; the largest 32-bit number if either has none."""
    if a is None or b is None:
        return _M
    swap = lambda x: (x & 15) << 4 | x >> 4

    def around(x: int, y: int, m: int) -> int:
        return min(abs(x - y), m - abs(x - y))

    d = int(a[0] != b[0])
    n = around(swap(a[1]), swap(b[1]), 256)
    d += n if n <= 1 else n * 12
    for s in (4, 0):
        n = around(swap(a[2]) >> s & 15, swap(b[2]) >> s & 15, 16)
        d += n if n <= 1 else (n - 1) * 12
    x, y = (np.frombuffer(z[3:], np.uint8) for z in (a, b))
    for s in (0, 2, 4, 6):
        d += int(np.abs((x >> s & 3).astype(int) - (y >> s & 3)).sum())
    return d


def relatedness(a: tuple[int, str, str], b: tuple[int, str, str], da: bytes | None, db: bytes | None) -> float:
    return 0.5 * (1 - min(1.0, quartile_distance(da, db) / 150)) + 0.5 * ctph_similarity(a, b) / 100


def token_hashes(items: list[str]) -> np.ndarray:
    return np.array([mix_word(mix64(x.encode(), 0)) for x in items], np.uint64)
