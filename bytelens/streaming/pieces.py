"""Payloads that arrive in pieces, in any order and more than once: their digests and their chunks.

Pieces of a key are numbered from 0. A piece that comes early waits in the state, one that comes again is dropped. What is
kept of the pieces before is the state of the digest or of the rolling hash, never their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytelens.functions.chunking import ChunkSizes
from bytelens.session import ship


def _in_order(pieces: DataFrame, fold: Callable, columns: dict[str, str], mode: str, key: str, seq: str, payload: str, last: str | None) -> DataFrame:
    """fold(held state or None, pieces that now follow, whether they are all) -> (rows, state)."""
    ship(pieces.sparkSession)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, total, at, held, kept = state.get if state.exists else (0, -1, [], [], None)
        wait = dict(zip(at, held, strict=True))
        for pdf in frames:
            marks = pdf[last].tolist() if last else [False] * len(pdf)
            for s, p, end in zip(pdf[seq].tolist(), pdf[payload].tolist(), marks, strict=True):
                if s >= done:
                    wait.setdefault(s, b"" if p is None else bytes(p))
                if end:
                    total = s + 1
        before, ready = done, []
        while done in wait:
            ready.append(wait.pop(done))
            done += 1
        rows, kept = fold(kept, ready, done, done == total and before < total)
        state.update((done, total, list(wait), list(wait.values()), kept))
        yield pd.DataFrame([(k[0], *r) for r in rows], columns=[key, *columns])

    kind = pieces.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    held = "done long, total long, at array<long>, held array<binary>, kept binary"
    return pieces.groupBy(key).applyInPandasWithState(step, out, held, mode, GroupStateTimeout.NoTimeout)


def running_digests(pieces: DataFrame, digest: str = "sha256", key: str = "key", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """(key, pieces, n_bytes, digest): the SHA-256 or BLAKE3 of each key's pieces 0, 1, 2, ... as far as they have come without a
    gap. Null pieces are empty. Equal to the digest of the whole for any cutting and order of arrival."""

    def fold(kept: bytes | None, ready: list[bytes], done: int, _: bool) -> tuple[list, bytes]:
        from bytelens.functions.digests import DIGESTS

        n = int.from_bytes(kept[:8], "little") if kept else 0
        h = DIGESTS[digest].load(bytes(kept[8:])) if kept else DIGESTS[digest]()
        for p in ready:
            h.update(p)
            n += len(p)
        return [(done, n, h.digest())], n.to_bytes(8, "little") + h.dump()

    return _in_order(pieces, fold, {"pieces": "long", "n_bytes": "long", "digest": "binary"}, "update", key, seq, payload, None)


def running_chunks(pieces: DataFrame, sizes: ChunkSizes, key: str = "key", seq: str = "seq", payload: str = "payload", last: str = "last") -> DataFrame:
    """(key, start, end, hash): each content-defined chunk once, as soon as no further byte can change it.

    ``last`` marks the piece that ends its payload; a payload without one keeps its open chunk. Null pieces are empty. The
    chunks are those of the whole payload for any cutting and order of arrival.
    """

    def fold(kept: bytes | None, ready: list[bytes], _: int, ended: bool) -> tuple[list, bytes]:
        from bytelens.functions.chunking import OpenChunks
        from bytelens.functions.hashes import signed

        at = [int.from_bytes(kept[i : i + 8], "little") for i in (0, 8, 16)] if kept else [0, 0, 0]
        now = OpenChunks(sizes, *at)
        rows = now.feed(b"".join(ready)) + (now.close() if ended else [])
        return [(a, b, signed(h)) for a, b, h in rows], b"".join(x.to_bytes(8, "little") for x in (now.h, now.read, now.start))

    return _in_order(pieces, fold, {"start": "long", "end": "long", "hash": "long"}, "append", key, seq, payload, last)
