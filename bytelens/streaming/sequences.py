"""Streaming forms of hashes that need their pieces in order: each key keeps its state and what came early."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_checksums(pieces: DataFrame, key: str = "key", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """(key, pieces, crc): the raw CRC-32C of each key's pieces 0, 1, 2, ... as far as they have come without a gap.

    A piece that comes early waits in the state; one that comes again is dropped.
    """
    from bytelens.functions.payload import crc32c

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, crc, at, held = state.get if state.exists else (0, 0, [], [])
        wait = dict(zip(at, held, strict=True))
        for pdf in frames:
            for s, p in zip(pdf[seq].tolist(), pdf[payload].tolist(), strict=True):
                if s >= done:
                    wait.setdefault(s, bytes(p))
        while done in wait:
            crc = crc32c(wait.pop(done), crc)
            done += 1
        state.update((done, crc, list(wait), list(wait.values())))
        yield pd.DataFrame({key: [k[0]], "pieces": [done], "crc": [crc]})

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, pieces long, crc long", "done long, crc long, at array<long>, held array<binary>", "update", GroupStateTimeout.NoTimeout)


def running_counters(values: DataFrame, k: int, p: float, key: str = "key", value: str = "value") -> DataFrame:
    """(key, n, items, counts, quantile): Misra-Gries counters of whole numbers and the five-marker quantile of each key's
    values, in the order in which they come. The state of a key is k counters and five markers."""
    from bytelens.functions.sketches import MisraGries, P2Quantile

    def step(kk: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heavy, mid = MisraGries(k), P2Quantile(p)
        if state.exists:
            heavy.n, items, counts, mid.count, q, n, want = state.get
            heavy.counts = dict(zip(items, counts, strict=True))
            mid.q, mid.n, mid.want = list(q), list(n), list(want)
        for pdf in frames:
            for v in pdf[value].tolist():
                if v is not None and v == v:
                    heavy.update(int(v))
                    mid.update(float(v))
        state.update((heavy.n, list(heavy.counts), list(heavy.counts.values()), mid.count, mid.q, mid.n, mid.want))
        yield pd.DataFrame({key: [kk[0]], "n": [heavy.n], "items": [list(heavy.counts)], "counts": [list(heavy.counts.values())], "quantile": [mid.estimate()]})

    kind = values.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n long, items array<long>, counts array<long>, quantile double"
    held = "n long, items array<long>, counts array<long>, count long, q array<double>, at array<long>, want array<double>"
    return values.groupBy(key).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)
