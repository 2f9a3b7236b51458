"""Hashes whose every step needs the one before, for many payloads at a time: step k of all that are long enough is
one array operation, so the cost is that of the longest payload's steps and of all bytes once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_FEW = 16


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all payloads, n + 1 places where they begin); null is empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer payload stands alone."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def fold(raw: np.ndarray, at: np.ndarray, first: int, kind: type, step: Callable, one: Callable[[int, bytes], list[int]], every: bool = False) -> np.ndarray:
    """The state after the last unit of each payload, or with ``every`` after each unit of all.

    step(states, units) -> states, of arrays; one(state, units) -> the states after each unit, in plain numbers, for the
    few payloads that are much longer than the others.
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    lengths, begin = n[order], at[:-1][order]
    state = np.full(len(n), first, kind)
    seen = np.zeros(len(raw), kind) if every else None
    alive = int((lengths > 0).sum())
    k = 0
    while alive > _FEW:
        stop = int(lengths[alive - 1])
        here = begin[:alive]
        while k < stop:
            now = state[:alive] = step(state[:alive], raw[here + k])
            if every:
                seen[here + k] = now
            k += 1
        alive = int(np.searchsorted(-lengths, -k, "left"))
    for i in range(alive):
        states = one(int(state[i]), raw[begin[i] + k : begin[i] + lengths[i]].tolist())
        state[i] = states[-1]
        if every:
            seen[begin[i] + k : begin[i] + lengths[i]] = states
    if every:
        return seen
    out = np.empty_like(state)
    out[order] = state
    return out
