"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at each output place it writes the character it stands on, then stays or steps on by a bit
that place and character fix. All texts share the bits, so two walks that an edit pulls apart soon meet again, and
the edit distance of texts becomes the Hamming distance of what is written. Where they don't meet soon, an anchor
brings them together: after about one character in GAP, chosen by the last CONTEXT characters, a walk begins anew. So
what an edit spoils ends at the next anchor, in texts of any length.

A fingerprint samples SLOTS places: each slot takes the segment whose anchor has the slot's least hash, the same one in
two texts that share it, and a place in it that depends on its written length alone, and consistently: of two lengths, the
share of common places is their ratio. Each sample keeps one hashed bit.

The bits repeat after PERIOD places, so a walk is a run of a finite automaton over character classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, islice
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.llm.blocks import apart, block_pairs, confirm, sized, split_stars, stars
from bytelens.llm.graph import connected_components
from bytelens.llm.scratch import Scratch
from bytelens.llm.tidy import small_batches
from bytelens.session import ship

PERIOD, CLASSES, SLOTS = 512, 256, 512
#: An anchor stands after one character in GAP on average, chosen by so many characters before; its class is 0.
CONTEXT, GAP, ANCHOR = 4, 48, 0


def _mix(x: np.ndarray) -> np.ndarray:
    from bytelens.llm.words import mix

    return mix(x)


@cache
def _automaton() -> tuple[list, np.ndarray]:
    """(states, dwell): state[c] is the state after a character of class c, state[CLASSES] its number; dwell[s, c] places are written."""
    bit = (_mix(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(40)).astype(np.int64).reshape(PERIOD, CLASSES) & 1
    bit[PERIOD - 1] = 1  # no character is stood on for ever
    step = np.where(bit == 1, np.arange(PERIOD)[:, None], 4 * PERIOD)
    twice = np.concatenate([step, step + PERIOD])
    after = np.minimum.accumulate(twice[::-1], axis=0)[::-1][:PERIOD]
    dwell = after - np.arange(PERIOD)[:, None] + 1
    states: list[list] = [[None] * (CLASSES + 1) for _ in range(PERIOD)]
    for s in range(PERIOD):
        to = (s + dwell[s]) % PERIOD
        states[s][:CLASSES] = [states[k] for k in to.tolist()]
        states[s][ANCHOR] = states[0]
        states[s][CLASSES] = s
    dwell[:, ANCHOR] = 1
    return states, dwell.astype(np.int32)


@cache
def _records() -> tuple[np.ndarray, np.ndarray]:
    """For each slot the places that are its least so far, of all up to 2^40, flat; and where each slot's begin."""
    flat, begin = [], [0]
    for k in range(SLOTS):
        at, i = 0, 0
        while at < 1 << 40:
            flat.append(at)
            u = (int(_mix(np.array([k * 4096 + i + 77], np.uint64))[0]) + 1) / (2.0**64 + 2)
            at, i = max(at + 1, int((at + 1) / u)), i + 1
        begin.append(len(flat))
    return np.array(flat, np.int64), np.array(begin, np.int64)


@cache
def _slots() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All slots' records in one sorted array, the slots' numbers, and a multiplier for each."""
    flat, begin = _records()
    slot = np.arange(SLOTS, dtype=np.int64)
    return np.repeat(slot << 41, np.diff(begin)) + flat, slot, _mix(slot.astype(np.uint64) + np.uint64(99)) | np.uint64(1)


def sample_places(lengths: np.ndarray, slot: np.ndarray | None = None) -> np.ndarray:
    """A place below its length for each slot, all if none are named; equal for two lengths with the chance of their ratio."""
    keys, every, _ = _slots()
    slot = every if slot is None else slot
    return keys[np.searchsorted(keys, (slot << 41) + lengths, "left") - 1] - (slot << 41)


@cache
def _few_places(most: int = 1024) -> np.ndarray:
    """``sample_places`` of each slot and all lengths up to ``most``."""
    lengths = np.arange(1, most + 1, dtype=np.int64)[:, None] + np.zeros(SLOTS, np.int64)
    return np.concatenate([np.zeros((1, SLOTS), np.int32), sample_places(lengths).astype(np.int32)])


def _kinds(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, np.maximum(code, 1), 128 + (code * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


def anchors(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the characters, given by code point, that end a segment."""
    m = max(len(code) - CONTEXT + 1, 0)
    h = _context([code[j : j + m] for j in range(CONTEXT)])
    at = np.flatnonzero(_chosen(h))
    return at + CONTEXT - 1, h[at]


def _context(characters: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(characters[0]), np.uint64)
    for c in characters:
        h = h * np.uint64(0x100000001B3) + c
    return _mix(h)


def _chosen(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(GAP) == 0


def fingerprint(text: str) -> bytes:
    """SLOTS bits; all zero for the empty text."""
    if not text:
        return bytes(SLOTS // 8)
    states, dwell = _automaton()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(code)
    last, context = anchors(code)
    kind[last] = ANCHOR
    walked = accumulate(kind.tobytes(), getitem, initial=states[0])
    at = np.fromiter(map(itemgetter(CLASSES), islice(walked, len(kind))), np.int32, len(kind))
    ends = np.cumsum(dwell[at, kind], dtype=np.int64)
    # Segments begin with the text and after each anchor that doesn't end it; of equal names the first counts.
    open_ = last < len(code) - 1
    begin = np.concatenate([[0], ends[last[open_]]])
    size = np.diff(begin, append=ends[-1])
    names, first = np.unique(np.concatenate([[np.uint64(7)], context[open_]]), return_index=True)
    _, slot, factor = _slots()
    pick = _least(names, factor, slot)
    own = first[pick]
    seen = code[np.searchsorted(ends, begin[own] + sample_places(size[own]), "right")].astype(np.uint64)
    return _bits(seen, names[pick], slot).tobytes()


@cache
def _next() -> np.ndarray:
    """The number of the state after each state and class."""
    states, _ = _automaton()
    return np.array([[row[c][CLASSES] for c in range(CLASSES)] for row in states], np.int16)


def fingerprints_of(texts: list[str], most: int = 1_000_000) -> list[bytes]:
    """As ``fingerprint``, of many texts, in slices of about ``most`` characters: all segments of a slice are walked together."""
    return chained_fingerprints(texts, [False] * len(texts), most)[0]


def chained_fingerprints(texts: list[str], joined: list[bool], most: int = 1_000_000) -> tuple[list[bytes], list[bytes]]:
    """As ``fingerprint``, of all texts; and of each text k where joined[k], when of its n characters the last n // 3
    are replaced by as many of text k + 1, or all."""
    from bytelens.llm.tokens import slices

    out: list[bytes] = []
    edited: list[bytes] = []
    for a, b in slices(np.array([max(1, len(t)) for t in texts], np.int64), most):
        own, made = _some_fingerprints(texts[a : b + bool(joined[b - 1])], np.array(joined[a:b], bool))
        out += own[: b - a]
        edited += made
    return out, edited


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at start and have count numbers."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _walk(kind: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each character is written, of segments that begin at ``begin``, 0 first; and how much before each and in all."""
    from bytelens.functions import lockstep

    after, dwell = _next(), _automaton()[1]
    rows = after.tolist()
    step = lambda s, x: after[s, x]
    one = lambda s, xs: list(accumulate(xs, lambda q, x: rows[q][x], initial=s))[1:]
    state = np.zeros(len(kind), np.int16)
    state[1:] = lockstep.fold(kind, np.append(begin, len(kind)), 0, np.int16, step, one, every=True)[:-1]
    state[begin] = 0
    times = dwell[state, kind]
    return times, np.concatenate([[0], np.cumsum(times, dtype=np.int64)])


def _some_fingerprints(texts: list[str], joined: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    n = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return [bytes(SLOTS // 8)] * len(texts), [bytes(SLOTS // 8)] * int(joined.sum())
    kind = _kinds(code)
    last, context = anchors(code)
    doc = np.searchsorted(at, last, "right") - 1
    inside = last - at[doc] >= CONTEXT - 1  # the characters before an anchor are of its text
    last, context, doc = last[inside], context[inside], doc[inside]
    kind[last] = ANCHOR
    open_ = last < at[doc + 1] - 1
    starts = at[:-1][n > 0]
    begin, name = _by_place([starts, last[open_] + 1], [np.full(len(starts), 7, np.uint64), context[open_]])
    times, written = _walk(kind, begin)
    own = np.searchsorted(begin, at)
    prints = _Prints(code, times, written[begin], np.diff(written[np.append(begin, len(kind))]), name)
    k = np.flatnonzero(joined)
    if not len(k):
        return prints.of(own[:-1], np.diff(own)), []
    # An edited text has the segments that end before its cut, new ones around it, and those of the next text that begin
    # after an anchor there, the last of them cut off.
    cut, there, end = at[k] + n[k] - n[k] // 3, at[k + 1], at[k + 1] + np.minimum(n[k] // 3, n[k + 1])
    a, f = np.searchsorted(last, at[k]), np.searchsorted(last, there)
    closed, met = np.searchsorted(last, cut) - a, np.searchsorted(last, end) - f
    last_, context_ = np.append(last, 0), np.append(context, np.uint64(0))
    from_ = np.where(closed > 0, last_[a + closed - 1] + 1, at[k])
    named = np.where(closed > 0, context_[a + closed - 1], np.uint64(7))
    to = np.where(met > 0, last_[f] + 1, end)
    pieces = _ranges(np.stack([from_, there], 1).reshape(-1), np.stack([cut - from_, to - there], 1).reshape(-1))
    new_kind = kind[pieces]
    new_at = np.concatenate([[0], np.cumsum(cut - from_ + to - there)])
    begins, names = [new_at[:-1][np.diff(new_at) > 0]], [named[np.diff(new_at) > 0]]
    for q in range(CONTEXT - 1):  # anchors that characters of both texts set
        both = np.flatnonzero((there + q < end) & (cut - at[k] + q >= CONTEXT - 1))
        h = _context([code[(cut[both] if o < 0 else there[both]) + o] for o in range(q - CONTEXT + 1, q + 1)])
        both, h = both[_chosen(h)], h[_chosen(h)]
        place = new_at[both] + (cut - from_)[both] + q
        new_kind[place] = ANCHOR
        inner = place + 1 < new_at[both + 1]
        begins.append(place[inner] + 1)
        names.append(h[inner])
    new_begin, new_name = _by_place(begins, names)
    new_own = np.searchsorted(new_begin, new_at)
    if len(new_kind):
        new_times, new_written = _walk(new_kind, new_begin)
        first = prints.add(new_written[new_begin] + written[-1], np.diff(new_written[np.append(new_begin, len(new_kind))]), new_name)
        prints.write(code[pieces], new_times)
    else:
        first = len(begin)
    tail = last_[f + met - 1] + 1
    part = (met > 0) & (tail < end)
    tails = prints.add(written[tail[part]], written[end[part]] - written[tail[part]], context_[f + met - 1][part])
    start = np.stack([own[k], first + new_own[:-1], own[k + 1] + 1, tails + np.cumsum(part) - part], 1)
    count = np.stack([closed, np.diff(new_own), np.maximum(met - 1, 0), part], 1)
    seen = prints.of(np.concatenate([own[:-1], start.reshape(-1)]), np.concatenate([np.diff(own), count.reshape(-1)]), [1] * len(texts) + [4] * len(k))
    return seen[: len(texts)], seen[len(texts) :]


def _by_place(begins: list[np.ndarray], names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    begin, name = np.concatenate(begins), np.concatenate(names)
    order = np.argsort(begin, kind="stable")
    return begin[order], name[order]


class _Prints:
    """What is written of many segments (place, size, name), and fingerprints of texts made of them."""

    def __init__(self, code: np.ndarray, times: np.ndarray, at: np.ndarray, size: np.ndarray, name: np.ndarray):
        self.parts, self.at, self.size, self.name = [np.repeat(code, times)], at, size, name

    def write(self, code: np.ndarray, times: np.ndarray) -> None:
        self.parts.append(np.repeat(code, times))

    def add(self, at: np.ndarray, size: np.ndarray, name: np.ndarray) -> int:
        """The number of the first of more segments."""
        first = len(self.at)
        self.at, self.size, self.name = (np.concatenate(x) for x in ((self.at, at), (self.size, size), (self.name, name)))
        return first

    def of(self, start: np.ndarray, count: np.ndarray, ranges: list[int] | None = None) -> list[bytes]:
        """Of each text, whose segments are those of one range or of so many ranges one after another; of equal names the first counts."""
        segments = _ranges(start, count)
        if ranges is not None:
            count = np.add.reduceat(count, np.cumsum(ranges) - ranges)
        _, slot, factor = _slots()
        said = np.concatenate(self.parts)
        few, ends, names = _few_places(), np.cumsum(count).tolist(), self.name[segments]
        out = np.zeros((len(count), SLOTS // 8), np.uint8)
        full = np.flatnonzero(count)
        for a in range(0, len(full), 256):
            own = full[a : a + 256]
            pick = np.empty((len(own), SLOTS), np.int64)
            for row, k in enumerate(own.tolist()):
                b = ends[k - 1] if k else 0
                pick[row] = _least(names[b : ends[k]], factor, slot)
                pick[row] += b
            size = self.size[segments[pick]]
            place = few[np.minimum(size, len(few) - 1), slot].astype(np.int64)
            r, c = np.nonzero(size >= len(few))
            place[r, c] = sample_places(size[r, c], c)
            out[own] = _bits(said[self.at[segments[pick]] + place].astype(np.uint64), names[pick], slot)
        return [x.tobytes() for x in out]


def _least(names: np.ndarray, factor: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each slot the first name with the least product."""
    if len(names) <= 4096:
        return (factor[:, None] * names).argmin(1)
    best, pick = np.full(SLOTS, np.iinfo(np.uint64).max), np.zeros(SLOTS, np.int64)
    for a in range(0, len(names), 4096):
        drawn = factor[:, None] * names[a : a + 4096]
        k = drawn.argmin(1)
        least = drawn[slot, k]
        pick = np.where(least < best, a + k, pick)
        best = np.minimum(least, best)
    return pick


def _bits(seen: np.ndarray, names: np.ndarray, slot: np.ndarray) -> np.ndarray:
    bits = _mix(_mix(seen + (slot.astype(np.uint64) << np.uint64(32))) + names) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8), axis=-1)


def agreement(a: bytes, b: bytes) -> float:
    """The share of slots that agree but by chance: about the common segments among all of both texts. Below 0 by chance."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 1 - 2 * differ / SLOTS


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: about the share of either text that both have, from their ``agreement``."""
    both = max(0.0, agreement(a, b))
    return 2 * both / (1 + both)


def _fingerprints(series: pd.Series) -> pd.Series:
    return pd.Series([p.hex() for p in fingerprints_of([x or "" for x in series])], dtype=object)


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint, in hex, of each whole text; null is empty."""
    ship(docs.sparkSession)
    f = F.pandas_udf(_fingerprints, "string")
    return docs.withColumn(out, f(F.coalesce(F.col(text_col), F.lit(""))))


def agreement_of(a: Column, b: Column) -> Column:
    """As ``agreement``, of two columns of fingerprints as arrays of longs."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SLOTS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return 1 - 2 * differ / F.lit(float(SLOTS))


def band_shape(n: int, aim: float, miss: float = 0.05) -> tuple[int, int]:
    """(bands, bits): so many bits that unrelated texts of a corpus of n seldom share a band by chance, and so many bands that
    two texts whose agreement is ``aim`` share none with a chance of ``miss`` at most."""
    bits = min(48, max(12, math.ceil(math.log2(max(n, 2))) + 3))
    return math.ceil(math.log(miss) / math.log(1 - ((1 + aim) / 2) ** bits)), bits


def _band_keys(count: int, bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.argsort(_mix(np.arange(count * SLOTS, dtype=np.uint64) + np.uint64(9)).reshape(count, SLOTS), axis=1)[:, :bits]
        masks = np.zeros((count, SLOTS // 64), np.uint64)
        np.bitwise_or.at(masks, (np.repeat(np.arange(count), bits), places.reshape(-1) // 64), np.uint64(1) << (places.reshape(-1) % 64).astype(np.uint64))
        for batch in batches:
            words = np.asarray(batch.column("words").flatten()).view(np.uint64).reshape(batch.num_rows, -1)
            for a in range(0, batch.num_rows, 2048):
                own = words[a : a + 2048]
                h = _mix(np.broadcast_to(np.arange(count, dtype=np.uint64) + np.uint64(1), (len(own), count)))
                for i in range(words.shape[1]):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + (own[:, i, None] & masks[None, :, i]))
                node = batch.column("node").slice(a, len(own)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, count)), pa.array(h.reshape(-1).view(np.int64))], ["node", "key"])

    return keys


def band_keys(nodes: DataFrame, count: int, bits: int) -> DataFrame:
    """(node, key) of nodes (node, words): ``count`` keys of ``bits`` sampled bits each; texts that share one are candidates."""
    return nodes.select("node", "words").mapInArrow(_band_keys(count, bits), "node long, key long")


def within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` insertions, deletions and substitutions of characters turn a into b.

    For each number of edits, how far each diagonal gets; so the cost grows with the square of ``most`` and not with the
    lengths, but for the comparison of equal stretches.
    """

    def common(i: int, j: int) -> int:
        """How many characters of a from i on equal those of b from j on."""
        start, step = i, 1
        while a[i : i + step] == b[j : j + step] and i < len(a) and j < len(b) and len(a[i : i + step]) == step:
            i, j, step = i + step, j + step, 2 * step
        while step > 1:
            step //= 2
            if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
                i, j = i + step, j + step
        return i - start

    if len(a) > len(b):
        a, b = b, a
    m, goal = len(a), len(b) - len(a)
    if goal > most:
        return False
    far = {0: common(0, 0)}
    if far[0] == m and goal == 0:
        return True
    for e in range(1, most + 1):
        new = {}
        for d in range(max(-e, goal - (most - e)), min(e, goal + (most - e)) + 1):
            i = max(far.get(d, -2) + 1, far.get(d + 1, -2) + 1, far.get(d - 1, -2))
            i = min(i, m, len(b) - d)
            if i < 0 or i + d < 0:
                continue
            new[d] = i + common(i, i + d)
        if new.get(goal, -1) >= m:
            return True
        far = new
    return False


#: Pairs are verified together in tables of so many diagonals at most, over so many characters of texts, and alone where they are few.
DIAGONALS, CHARACTERS, FEW_PAIRS = 400_000, 1_000_000, 6


def within_all(a: list[str], b: list[str], pairs: list[tuple[int, int]], most: list[int]) -> np.ndarray:
    """For each pair (p, q), ``within`` of a[p], b[q] and its ``most``.

    Pairs of about one bound go through its steps together. Equal stretches are told by sums of hashes there, which can
    only take too much for equal, so what passes is tried once more by itself.
    """
    good = np.zeros(len(pairs), bool)
    held: list[int] = []
    seen: dict[tuple[int, int], int] = {}

    def settle() -> None:
        few = len(held) < FEW_PAIRS
        may = np.ones(len(held), bool) if few else _may_be_within([(a[pairs[k][0]], b[pairs[k][1]]) for k in held], np.array([most[k] for k in held], np.int64))
        for k, ok in zip(held, may.tolist(), strict=True):
            good[k] = ok and within(a[pairs[k][0]], b[pairs[k][1]], most[k])
        held.clear()
        seen.clear()

    for k in sorted(range(len(pairs)), key=lambda k: most[k]):
        p, q = pairs[k]
        new = {(0, p): len(a[p]), (1, q): len(b[q])}
        if held and ((len(held) + 1) * (2 * most[k] + 3) > DIAGONALS or most[k] > 8 + 3 * most[held[0]] // 2 or sum((seen | new).values()) > CHARACTERS):
            settle()
        held.append(k)
        seen.update(new)
    settle()
    return good


def _may_be_within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """As ``within`` for each pair, step by step for all; never False for one that is."""
    place: dict[str, int] = {}
    size = 0
    for x in (x for pair in pairs for x in pair):
        if x not in place:
            place[x], size = size, size + len(x)
    code = np.frombuffer("".join(place).encode("utf-32-le", "surrogatepass"), np.uint32)
    power = np.full(size + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_mix(code.astype(np.uint64)) * power[:-1], out=sums[1:])
    # Of two texts the first stands before the second, so the powers of the one are those of the other times a power.
    pairs = [(x, y) if place[x] <= place[y] else (y, x) for x, y in pairs]
    pa_, pb = (np.array([place[pair[k]] for pair in pairs], np.int64) for k in (0, 1))
    m, n = (np.array([len(pair[k]) for pair in pairs], np.int64) for k in (0, 1))
    goal, top = n - m, int(most.max())
    d = np.arange(-top - 1, top + 2)
    none = -(1 << 30)
    far = np.full((len(pairs), len(d)), none, np.int64)
    rows, good = np.arange(len(pairs)), np.zeros(len(pairs), bool)
    open_ = np.abs(goal) <= most
    for e in range(top + 1):
        if not open_.all():
            keep = np.flatnonzero(open_)
            rows, far, pa_, pb, m, n, goal, most = (x[keep] for x in (rows, far, pa_, pb, m, n, goal, most))
        if not len(rows):
            break
        left = int(most.max()) - e
        lo, hi = max(-e, int(goal.min()) - left) + top + 1, min(e, int(goal.max()) + left) + top + 1
        own = d[lo : hi + 1]
        end = np.minimum(m[:, None], n[:, None] - own)
        if e:
            f = far[:, lo - 1 : hi + 2]
            new = np.minimum(np.maximum(np.maximum(f[:, 1:-1], f[:, 2:]) + 1, f[:, :-2]), end)
        else:
            new = np.zeros((len(rows), 1), np.int64)
        new[new < np.maximum(0, -own)] = none
        r, c = np.nonzero((new >= 0) & (new < end) & (np.abs(own - goal[:, None]) <= (most - e)[:, None]))
        i = new[r, c]
        new[r, c] = i + _equal_from(code, sums, power, pa_[r] + i, pb[r] + i + own[c], end[r, c] - i)
        far[:, lo : hi + 1] = new
        there = far[np.arange(len(rows)), goal + top + 1] >= m
        good[rows[there]] = True
        open_ = ~there & (most > e)
    return good


def _equal_from(code: np.ndarray, sums: np.ndarray, power: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many characters from places x on equal those from y on, up to ``room``: first in steps that double, then that halve."""
    got = (code[x] == code[y]).astype(np.int64)
    on = np.flatnonzero(got)
    shift = power[y[on] - x[on]]

    def equal(step: int, at: np.ndarray) -> np.ndarray:
        k = on[at]
        a, b = x[k] + got[k], y[k] + got[k]
        fits = room[k] - got[k] >= step
        a_end, b_end = np.where(fits, a + step, a), np.where(fits, b + step, b)
        same = fits & ((sums[a_end] - sums[a]) * shift[at] == sums[b_end] - sums[b])
        got[k] += step * same
        return same

    ended, step, at = [], 1, np.arange(len(on))
    while len(at):
        same = equal(step, at)
        ended.append(at[~same])
        at, step = at[same], 2 * step
    at = np.zeros(0, np.int64)
    for done in ended[::-1]:
        step //= 2
        at = np.concatenate([at, done])
        if step > 1:
            equal(step // 2, at)
    return got


def alike(a: str, b: str, percent: int) -> bool:
    """Whether at most 100 - percent hundredths of the longer text have to be edited."""
    return within(a, b, (100 - percent) * max(len(a), len(b)) // 100)


#: Counts of hashed pairs of characters: an edit changes four at most, by one each.
PROFILE = 512


def _profiles(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), PROFILE), np.int32)
    for k, t in enumerate(texts):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[k] = np.bincount((code[:-1] * np.uint32(2654435761) + code[1:] * np.uint32(2246822519)) >> np.uint32(23), minlength=PROFILE)[:PROFILE]
    return out


def _near(least: float):
    """Members of either block whose fingerprint is near one of another component in the other block."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        near = _agreement(a, b) >= least
        near &= a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()
        return pa.concat_tables([t.select(["grp", "node"]).filter(pa.array(near.any(k))) for t, k in ((a, 1), (b, 0))])

    return kernel


def _agreement(a: pa.Table, b: pa.Table) -> np.ndarray:
    x, y = (np.asarray(t["words"].combine_chunks().flatten()).view(np.uint64).reshape(t.num_rows, -1) for t in (a, b))
    differ = np.zeros((len(x), len(y)), np.int32)
    for i in range(x.shape[1]):
        differ += np.bitwise_count(x[:, None, i] ^ y[None, :, i])
    return 1 - 2 * differ / SLOTS


def _text_links(least: float, percent: int):
    """Links between blocks that join components: the likest pairs first, each verified on both texts.

    What the lengths and the counts of pairs of characters rule out isn't tried.
    """

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        like = _agreement(a, b)
        ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
        na, nb, ta, tb = (t[c].to_pylist() for c, t in (("node", a), ("node", b), ("text", a), ("text", b)))
        la, lb = np.array([len(t) for t in ta]), np.array([len(t) for t in tb])
        most = (100 - percent) * np.maximum(la[:, None], lb) // 100
        near = (like >= least) & (ca[:, None] != cb) & (np.abs(la[:, None] - lb) <= most)
        i, j = np.nonzero(np.triu(near) if na == nb else near)  # a block that meets itself has each pair twice
        pa_, pb = _profiles(ta), _profiles(tb)
        near = [np.abs(pa_[i[k : k + 4096]] - pb[j[k : k + 4096]]).sum(1) <= 4 * most[i[k : k + 4096], j[k : k + 4096]] for k in range(0, len(i), 4096)]
        if near:
            i, j = i[np.concatenate(near)], j[np.concatenate(near)]
        order = np.argsort(-like[i, j], kind="stable")
        i, j = i[order], j[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out, at, many = [], 0, 64
        while at < len(i):
            # What is still apart is verified together, more at a time as fewer components are left.
            own = slice(at, at + many)
            at, many = at + many, 4 * many
            tried = [(p, q) for p, q in zip(i[own].tolist(), j[own].tolist(), strict=True) if find(int(ca[p])) != find(int(cb[q]))]
            good = within_all(ta, tb, tried, [int(most[x]) for x in tried])
            for (p, q), ok in zip(tried, good, strict=True):
                x, y = find(int(ca[p])), find(int(cb[q]))
                if ok and x != y:
                    root[y] = x
                    out.append((na[p], nb[q]))
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("a", "b"))})

    return kernel


#: A block of fingerprints has about so many rows; one of texts so many bytes. More fingerprints than SENT are never a broadcast.
BLOCK_ROWS, TEXT_BYTES, SMALL_STAR, SENT = 2048, 4_000_000, 64, 50_000


def _near_in_stars(star: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(grp, node) of members (grp, node, comp, words) that agree with one of another component in their star.

    Stars of up to SMALL_STAR members are joined with themselves, which puts out a member once; larger ones meet in blocks.
    """
    size = scratch.save(star.groupBy("grp").agg(F.count("*").alias("_n")).where("_n > 1"))
    held = star.join(size, "grp")
    small = held.where(F.col("_n") <= SMALL_STAR)
    a, b = (small.select("grp", *[F.col(c).alias(c + k) for c in ("node", "comp", "words")]) for k in "ab")
    near = (F.col("grp") == F.col("_g")) & (F.col("compa") != F.col("compb")) & (agreement_of(F.col("wordsa"), F.col("wordsb")) >= least)
    met = a.join(b.withColumnRenamed("grp", "_g"), near, "left_semi")
    large = held.where(F.col("_n") > SMALL_STAR).drop("_n").withColumn("weight", F.lit(1))
    blocks = block_pairs(large, _near(least), ("grp", "node"), scratch, block=BLOCK_ROWS)
    return met.select("grp", F.col("nodea").alias("node")).union(blocks)


def similar_texts(docs: DataFrame, printed: DataFrame, *, percent: int = 99, aim: float = 0.75, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(text_hash, component): groups of texts that edits of at most 100 - ``percent`` hundredths of the longer connect.

    printed: (id, text_hash, words), a row for each row of docs. Equal texts are one node; rows
    without an id are in none. Texts that share a band of sampled bits (see ``band_shape``) are candidates; those whose
    fingerprints have the ``least`` agreement are verified by the edit distance of the whole texts. A band's bucket meets
    its lead first; then what is still apart meets in blocks, whose tasks send out only links that join components. Every
    link is one; one per cent of random edits leaves an agreement of 0.86 on average and over 0.6 in nearly all texts, so nine in ten
    links of that size are found at least (tests/llm hold that against all pairs). Larger shares of edits need smaller ``aim`` and
    ``least``, and more bands.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # Texts are told apart by their hashes, also where two have one id.
    nodes = printed.where("id IS NOT NULL").groupBy("text_hash", "words").agg(F.min("id").alias("id"))
    nodes = scratch.save(nodes.select("text_hash", "id", F.xxhash64("text_hash").alias("node"), "words"))
    n = nodes.count()
    count, bits = band_shape(n, aim)
    # Spark takes an array for one number, so it would send fingerprints to every task when they are ten times too large.
    words = nodes.select("node", "words") if n <= SENT else nodes.select("node", "words").hint("merge")
    met = stars(band_keys(nodes, count, bits), scratch)
    side = lambda c: words.select(F.col("node").alias(c), F.col("words").alias("w" + c))
    like = agreement_of(F.col("wa"), F.col("wb"))
    near = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", like.alias("like")).where(F.col("like") >= least)
    # Each member with the lead that it is most like.
    best = scratch.save(near.groupBy("b").agg(F.max(F.struct("like", "a")).alias("x")).select("x.a", "b"))
    label = docs.sparkSession.createDataFrame([], "node long, component long")

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, text) of nodes, from docs."""
        own = docs.select(F.xxhash64(_text_hash(F.col(text_col))).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return own.join(sized(wanted), "node", "left_semi").dropDuplicates(["node"])

    if best.take(1):
        ends = best.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = texts(scratch.save(ends)).withColumnRenamed("text", "held")
        links = scratch.save(confirm(best, held, lambda a, b: alike(a, b, percent), scratch))
        if links.take(1):
            label = scratch.save(connected_components(links, scratch))
        scratch.release(2)
    own = met.select("a", F.col("a").alias("b")).distinct()  # a lead is a member too
    star = scratch.save(split_stars(met.union(own), label, scratch).join(words, "node"))
    if star.take(1):
        found = scratch.save(_near_in_stars(star, least, scratch).distinct())
        # Stars that share a member are one group from here on, so a text goes once to each block that it meets.
        one = connected_components(found.select("node", "grp"), scratch).select("node", F.col("component").alias("g"))
        part = found.select("node").distinct().join(one, "node", "left").select("node", F.coalesce("g", "node").alias("grp"))
        part = scratch.save(part.join(label, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp")).join(words, "node"))
        scratch.release(2)
        if part.take(1):
            whole = part.join(texts(scratch.save(part.select("node"))), "node").withColumn("weight", F.octet_length("text") + TEXT_BYTES // BLOCK_ROWS)
            links = scratch.save(block_pairs(whole, _text_links(least, percent), ("a", "b"), scratch, block=TEXT_BYTES))
            if links.take(1):
                label = scratch.save(connected_components(links.union(label), scratch))
        scratch.release(2)
    named = nodes.join(label, "node", "left").select("text_hash", "id", F.coalesce("component", "node").alias("group"))
    smallest = scratch.save(named.groupBy("group").agg(F.min("id").alias("component")))
    return named.join(smallest, "group").select("text_hash", "component")


def _text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by falling id, each part closed by its guest -> fingerprints of texts and of edited texts."""
    held = None  # (part, id, text, is guest)
    for pdf in batches:
        rows = [held] if held is not None else []
        rows += [(part, None if pd.isna(id_) else int(id_), text, guest) for part, id_, text, guest in zip(pdf["_part"], pdf["_id"], pdf["_text"], pdf["_guest"], strict=True)]
        if not rows:
            continue
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[3]]
        edited = [a[2][: len(a[2]) - len(a[2]) // 3] + b[2][: len(a[2]) // 3] for a, b in pairs]
        prints, changed = chained_fingerprints([r[2] for r in rows], [a[0] == b[0] and not a[3] for a, b in zip(rows, rows[1:], strict=False)] + [False])
        own = dict(zip(map(id, rows), prints, strict=True))
        out = []
        for (a, b), text, p in zip(pairs, edited, changed, strict=True):
            mine, other = own[id(a)], own[id(b)]
            text_hash = hashlib.sha256(a[2].encode("utf-8", "surrogatepass")).digest()
            out.append((a[1], len(a[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), mine.hex(), p.hex(), likeness(mine, p), likeness(mine, other), text_hash, np.frombuffer(mine, "<i8").tolist()))
        held = rows[-1]
        made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_hash", "words"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        yield made


def _part_of(cuts: np.ndarray):
    def part(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        return pa.array(np.where(known, at, len(cuts) + 1).astype(np.int32))

    return F.arrow_udf(part, "int")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 2_000) -> DataFrame:
    """For every row: its fingerprint and that of its text edited with the beginning of the next row's.

    Rows follow each other by falling id, null last, equal ids by text; the last is followed by the first. Of n
    code points the last n // 3 are replaced by as many of the next text, or all. Extra columns are ignored; no
    rows give none; a lone row follows itself.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    n = ids.count()
    parts = min(max(1, math.ceil(n / part_rows)), 16_384)  # beyond that parts grow; rows stream through them one by one
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_hash binary, words array<long>"
    known = ids.where("_id IS NOT NULL")
    cuts = sorted({int(c) for c in known.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    # The part of an id: how many cuts are at or above it, so that ids fall from part to part; null ids are the last.
    part = _part_of(np.array(cuts, np.int64))(F.col("_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_part", part)
    order = F.struct(F.col("_id").isNotNull().alias("k"), F.col("_id").alias("i"))
    heads = scratch.save(ids.withColumn("_part", part).groupBy("_part").agg(F.max(order).alias("h")))
    there = [r["_part"] for r in heads.select("_part").orderBy("_part").collect()]  # a row for each part
    if not there:
        return spark.createDataFrame([], schema)
    before = dict(zip(there, [there[-1], *there[:-1]], strict=True))
    lead = spark.createDataFrame([(k, v) for k, v in before.items()], "_part int, _to int")
    first = heads.join(F.broadcast(lead), "_part").select("_part", "_to", F.col("h.i").alias("_head"))
    guests = rows.join(F.broadcast(first), "_part").where(F.col("_id").eqNullSafe(F.col("_head")))
    # Of equal heads the least text stands first.
    guests = guests.groupBy("_to").agg(F.min("_text").alias("_text"), F.first("_head").alias("_id"))
    all_ = rows.select("_part", "_id", "_text", F.lit(False).alias("_guest")).union(guests.select(F.col("_to").alias("_part"), "_id", "_text", F.lit(True)))
    dealt = all_.repartitionById(len(cuts) + 2, "_part").sortWithinPartitions("_part", "_guest", F.col("_id").desc_nulls_last(), "_text")
    return dealt.select("_part", "_id", "_text", "_guest").mapInPandas(_follow, schema)


def edited_and_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """``edited_fingerprints`` with component_id, the smallest id of the group of ``similar_texts`` that holds the row's text.

    A row without an id has none. options are those of ``similar_texts``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    with small_batches(docs.sparkSession):
        made = scratch.save(edited_fingerprints(docs, id_col=id_col, text_col=text_col))
    scratch.release(3)  # the dealt texts are as large as the input
    printed = made.select(F.col("doc_id").alias("id"), "text_hash", "words")
    groups = similar_texts(docs, printed, id_col=id_col, text_col=text_col, scratch=scratch, **options)
    out = made.join(groups, "text_hash", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return out.drop("text_hash", "words", "component")
