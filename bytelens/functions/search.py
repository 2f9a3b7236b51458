"""Substring search in bytes. Offsets are of bytes; all matches include overlapping ones."""

from __future__ import annotations

#: Engines that differ in how, not in what they find, with the longest needle each takes.
ENGINES = {"two_way": None, "rabin_karp": None, "packed_pair": None, "shift_or": 64, "bitap64": 64, "bitap16": 16}


def find(needle: bytes, haystack: bytes, engine: str = "two_way") -> int | None:
    """First place, 0 for an empty needle; None without one or where the engine doesn't take the needle."""
    most = ENGINES[engine]
    if most and not 1 <= len(needle) <= most or engine == "packed_pair" and len(needle) < 2:
        return None
    i = haystack.find(needle)
    return None if i < 0 else i


def find_all(needle: bytes, haystack: bytes) -> list[int]:
    if not needle:
        return list(range(len(haystack) + 1))
    out, i = [], haystack.find(needle)
    while i >= 0:
        out.append(i)
        i = haystack.find(needle, i + 1)
    return out


def find_many(patterns: list[bytes], haystack: bytes) -> list[tuple[int, int]]:
    """(place, pattern) of every match, by where it ends, then by pattern."""
    found = [(i, k) for k, p in enumerate(patterns) if p for i in find_all(p, haystack)]
    return sorted(found, key=lambda x: (x[0] + len(patterns[x[1]]), x[1]))
