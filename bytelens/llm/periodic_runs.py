"""Periodic runs of words: stretches that repeat with a period, found and collapsed.

A run of period q has length at least max(least, exponent * q), so each of its words stands in a k-gram that stands
in the run once more, q words on, for k up to the length less q. With the smallest such k, words outside all k-grams that their document
repeats can join no run; they are masked, and only the stretches between them are searched.

A stretch is searched as Main and Lorentz do: a run that crosses the middle reaches half of its length to one side of
it, so for each period two comparisons at the middle tell whether there is one, and common extensions to both sides
give its ends. Then both halves are searched. Extensions come from names of windows of 1, 2, 4, ... words, which are equal
for equal windows; all middles and periods of one depth are compared at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.session import ship

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_overlap(exponent: int, least: int) -> int:
    """The least that any run has in common with itself a period on."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _repeated(ids: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Which words stand in a k-gram that stands in their document again. Words of two documents never have one id."""
    from bytelens.llm.words import mix

    n = len(ids)
    m = n - k + 1
    if m <= 0:
        return np.zeros(n, bool)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = mix(h + ids[j : j + m].astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole = np.flatnonzero(doc[:m] == doc[k - 1 :])
    order = np.argsort(h[whole], kind="stable")
    same = h[whole][order][1:] == h[whole][order][:-1]
    again = np.zeros(len(whole), bool)
    again[1:] |= same
    again[:-1] |= same
    at = whole[order[again]]
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _stretches(inside: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of at least that many words begin and end; none spans two documents."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    before = np.r_[False, inside[:-1]] & ~cut[:n]
    after = np.r_[inside[1:], False] & ~cut[1:]
    a, b = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = b - a >= least
    return a[long], b[long]


def _window_names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[l][i]: equal for equal windows of 2^l words from i; windows over the end have names of their own."""
    n = len(x)
    kind = np.int32 if n < 1 << 31 else np.int64
    names = [np.unique(x, return_inverse=True)[1].astype(kind)]
    width = 1
    while 2 * width <= longest:
        held = names[-1]
        m = n - 2 * width + 1
        new = -1 - np.arange(n, dtype=kind)
        if m > 0:
            new[:m] = np.unique(held[:m].astype(np.int64) * (n + 1) + held[width : width + m], return_inverse=True)[1]
        names.append(new)
        width *= 2
    return names


def _forward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on, j > i, before stop."""
    i, j, start = i.copy(), j.copy(), i
    for level in range(len(names) - 1, -1, -1):
        while True:
            go = np.flatnonzero(j + (1 << level) <= stop)
            go = go[names[level][i[go]] == names[level][j[go]]]
            if not len(go):
                break
            i[go] += 1 << level
            j[go] += 1 << level
    return i - start


def _backward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j, from start on."""
    i, j, end = i.copy(), j.copy(), i
    for level in range(len(names) - 1, -1, -1):
        while True:
            go = np.flatnonzero(i - (1 << level) >= start)
            go = go[names[level][i[go] - (1 << level)] == names[level][j[go] - (1 << level)]]
            if not len(go):
                break
            i[go] -= 1 << level
            j[go] -= 1 << level
    return end - i


def _crossing(names: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, seg: np.ndarray, start: np.ndarray, stop: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """(start, end, period) of the runs that cross the middle of their part lo..hi of stretch number seg."""
    most = (hi - lo) // exponent
    part = np.repeat(np.arange(len(lo)), most)
    p = np.arange(len(part)) - np.repeat(np.cumsum(most) - most, most) + 1
    mid = ((lo + hi) // 2)[part]
    need = ((exponent - 2) * p + 1) // 2  # on one side so many words equal those a period on
    level = np.frexp(np.maximum(need, 1))[1] - 1
    out = []
    # Right of the middle these begin with it; left of it they end a period before it.
    for at in (mid, mid - p - need):
        inside = np.flatnonzero((at >= lo[part]) & (at + need + p <= hi[part]))
        hit = [inside[need[inside] == 0]]
        for width in np.unique(level[inside]).tolist():
            own = inside[(level[inside] == width) & (need[inside] > 0)]
            for x in (at, at + need - (1 << width)):
                own = own[names[width][x[own]] == names[width][x[own] + p[own]]]
            hit.append(own)
        own = np.concatenate(hit)
        first, second, s = at[own], at[own] + p[own], seg[part[own]]
        a, e = first - _backward(names, first, second, start[s]), second + _forward(names, first, second, stop[s])
        long = e - a >= np.maximum(least, exponent * p[own])
        out.append(np.stack([a[long], e[long], p[own][long]], 1))
    return np.concatenate(out)


def find_runs(ids: np.ndarray, ends: np.ndarray, *, exponent: int = 4, least: int = 6) -> np.ndarray:
    """(document, start, length, period) of every maximal run, ordered.

    ids: a number for each word of each document, one after another; words of two documents never have the same. ends:
    words before each document and after the last. A run has at least ``least`` words and ``exponent`` of its smallest period.
    """
    a, b = _stretches(_repeated(ids, ends, least_overlap(exponent, least)), ends, least)
    if not len(a):
        return np.zeros((0, 4), np.int64)
    size = b - a
    stop = np.cumsum(size)
    start = stop - size
    x = ids[np.repeat(a - start, size) + np.arange(int(stop[-1]))]
    names = _window_names(x, int(size.max()))
    lo, hi, seg = start, stop, np.arange(len(a))
    found = []
    while len(lo):
        found.append(_crossing(names, lo, hi, seg, start, stop, exponent, least))
        mid = (lo + hi) // 2
        lo, hi, seg = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([seg, seg])
        large = hi - lo >= least
        lo, hi, seg = lo[large], hi[large], seg[large]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch with period q has period 2q as well: of equal stretches the smallest period counts.
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[once]
    which = np.searchsorted(stop, runs[:, 0], "right")
    begin = runs[:, 0] - start[which] + a[which]
    doc = np.searchsorted(ends, begin, "right") - 1
    out = np.stack([doc, begin - ends[doc], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:n]) > 0


def _collapser(exponent: int, least: int, slice_bytes: int):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.tidy import tidy
        from bytelens.llm.tokens import slices

        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, int)
            for a, b in slices(np.maximum(sizes, 1), slice_bytes):
                number = count()
                words, ids = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    own = text.split()  # at ASCII white space
                    name = defaultdict(number.__next__)
                    ids.append(np.fromiter(map(name.__getitem__, own), np.int64, len(own)))
                    words.append(own)
                ends = np.cumsum([0] + [len(w) for w in words])
                runs = find_runs(np.concatenate(ids), ends, exponent=exponent, least=least)
                first = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
                kept = []
                for k, own in enumerate(words):
                    mine = runs[first[k] : first[k + 1]]
                    if len(mine):
                        own = [own[i] for i in np.flatnonzero(~_dropped(mine, len(own))).tolist()]
                    kept.append(b" ".join(own))
                fields = [pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                cols = [batch.column(c).slice(a, b - a) for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(kept, pa.binary()).cast(pa.string())], [*(c for c in batch.schema.names if c != "_text"), "runs", "collapsed"])
        tidy()

    return collapse


def collapse_runs(docs: DataFrame, *, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4_000_000) -> DataFrame:
    """(id, runs, collapsed) for every row of docs.

    Words are split at ASCII white space. ``runs``: (start, length, period) of every maximal stretch with smallest period
    q and at least max(``least``, ``exponent`` * q) words, by start, then period. ``collapsed``: the words that no run holds after
    its first q, joined by one space. Null and empty texts have no runs and collapse to the empty text; repeated rows,
    equal ids and null ids are rows as others; extra columns are ignored; no rows give none. A document is searched whole,
    in one task, with a memory of some hundred bytes for each of its words.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run repeats at least once: exponent and least are 2 or more")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"))
    return rows.mapInArrow(_collapser(exponent, least, slice_bytes), f"`{id_col}` {kind}, runs {RUNS}, collapsed string")
