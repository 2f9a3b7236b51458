"""Many byte patterns in one scan: an automaton over all of them, stepped over whole buffers.

A state is the longest end of what was read that begins a pattern; its row in a dense table has the next state for each
byte. A buffer is cut into lanes that are stepped together, each beginning the longest pattern's length less one before
its own part, so it is in the right state when its part begins. The scan doesn't stop where a payload ends: a state knows all
patterns that end there, and those that begin before their payload does are left out. So the cost of a scan is that of
the bytes and of the hits, whatever the number of patterns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

LANES = 4096


class Automaton:
    """table[state * 256 + byte]: the next state; ends: first state of the chain of shorter ends, itself included, that is a pattern."""

    def __init__(self, patterns: Sequence[bytes]):
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, pattern in enumerate(patterns):
            if not pattern:  # stands everywhere and nowhere
                continue
            at = 0
            for x in pattern:
                if x not in children[at]:
                    children[at][x] = len(children)
                    children.append({})
                    own.append([])
                at = children[at][x]
            own[at].append(number)
        n = len(children)
        table = np.zeros((n, 256), np.int32)
        shorter, self.ends = np.zeros(n, np.int32), np.zeros(n, np.int32)
        level = [0]
        while level:  # by rising depth, so the state of a shorter end is ready
            deeper = []
            for at in level:
                if at:
                    table[at] = table[shorter[at]]
                self.ends[at] = at if own[at] else self.ends[shorter[at]]
                for x, child in children[at].items():
                    shorter[child] = table[at, x]
                    table[at, x] = child
                    deeper.append(child)
            level = deeper
        self.table = table.reshape(-1)
        self.next = np.where(np.arange(n) > 0, self.ends[shorter], 0)  # the next shorter end that is a pattern
        self.first = np.cumsum([0] + [len(x) for x in own])
        self.numbers = np.array([k for x in own for k in x], np.int64)

    def states(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last byte, state) where patterns end in the buffer."""
        n, before = len(raw), max(self.longest - 1, 0)
        if not n or not self.longest:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        lanes = max(1, min(LANES, n // max(64, 4 * before)))
        own = -(-n // lanes)
        padded = np.zeros(before + own * lanes, np.uint8)
        padded[before : before + n] = raw
        begin = np.arange(lanes, dtype=np.int64) * own
        state, places, found = np.zeros(lanes, np.int32), [], []
        for k in range(before + own):
            state = self.table[(state << 8) | padded[begin + k]]
            if k >= before:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    places.append(begin[hit] + k - before)
                    found.append(self.ends[state[hit]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        place, state = np.concatenate(places), np.concatenate(found)
        return place[place < n], state[place < n]

    def scan(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(payload, offset, pattern) of every match in payloads that begin at ``at``, by payload, end, then pattern."""
        place, state = self.states(raw)
        last, pattern = [], []
        while len(place):
            count = self.first[state + 1] - self.first[state]
            at_ = np.repeat(self.first[state] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            last.append(np.repeat(place, count))
            pattern.append(self.numbers[at_])
            more = np.flatnonzero(self.next[state])
            place, state = place[more], self.next[state[more]]
        if not last:
            return (np.zeros(0, np.int64),) * 3
        end, number = np.concatenate(last), np.concatenate(pattern)
        start = end + 1 - self.sizes[number]
        payload = np.searchsorted(at, end, "right") - 1
        inside = start >= at[payload]
        end, number, start, payload = end[inside], number[inside], start[inside], payload[inside]
        order = np.lexsort((number, end))
        return payload[order], (start - at[payload])[order], number[order]


@lru_cache(maxsize=4)
def automaton(patterns: tuple[bytes, ...]) -> Automaton:
    """Made once in each worker."""
    return Automaton(patterns)
