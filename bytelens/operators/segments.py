"""Payloads cut into pieces that many tasks hold: statistics equal to those of the whole.

What looks at n bytes at a time gets each piece with the n - 1 bytes before it. What has a state at both borders of a piece
is folded in a tree of neighbouring pieces. Either way a payload of any length is many tasks' work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.functions import payload as pl
from bytelens.scratch import Scratch, ordered
from bytelens.session import ship


def with_context(pieces: DataFrame, n: int, *, key: str = "key", seq: str = "seq", payload: str = "payload", scratch: Scratch | None = None) -> DataFrame:
    """pieces with up to n - 1 bytes of their payload put before each, so every run of n bytes stands in one piece exactly.

    Pieces of a key follow each other by seq, each once; null ones are empty. Pieces shorter than n - 1 reach back to several before.
    Only those ends are dealt by key and seq; the pieces stay where they are until they meet them.
    """
    if n <= 1:
        return pieces
    scratch = scratch or Scratch(pieces.sparkSession)
    some = pieces.where(F.length(payload) > 0)
    ends = some.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.substring(payload, F.greatest(F.lit(1), F.length(payload) - n + 2), F.lit(n - 1)).alias("_end"))
    at = scratch.save(ordered(ends, [F.col("_k"), F.col("_s")], scratch))
    before = at.select("_k", "_s", "pos")
    # Of each piece the ends of those that follow it, nearest last.
    near = None
    for back in range(1, n):
        one = at.select(F.col("_k"), (F.col("pos") + back).alias("pos"), F.struct(F.lit(-back).alias("o"), F.col("_end").alias("e")).alias("x"))
        near = one if near is None else near.union(one)
    held = near.groupBy("_k", "pos").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda s, v: F.concat(s, v["e"]))
    context = before.join(held, ["_k", "pos"]).select("_k", "_s", joined.alias("_c"))
    context = context.select("_k", "_s", F.substring("_c", F.greatest(F.lit(1), F.length("_c") - n + 2), F.lit(n - 1)).alias("_c"))
    out = some.join(context, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col(seq) == F.col("_s")), "left")
    return out.select(*[F.concat(F.coalesce("_c", F.lit(b"")), F.col(payload)).alias(c) if c == payload else F.col(c) for c in pieces.columns])


def _counted(n: int):
    """Rows of whole payloads, piece by piece -> (key, distinct_grams, observations, most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[bytes] = []
        out: list[tuple] = []

        def close() -> None:
            g = pl.ngrams(np.frombuffer(b"".join(held), np.uint8), n)
            if len(g):
                m = np.unique(g, return_counts=True)[1]
                out.append((*now, len(m), len(g), int(m.max())))
            held.clear()

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((kind, *[pa.int64()] * 3))], ["key", "distinct_grams", "observations", "most"])
            out.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (k,):
                    if now is not None:
                        close()
                    now = (k,)
                held.append(raw or b"")
            yield rows(kind)
        if now is not None:
            close()
            yield rows(kind)

    return count


def piece_ngrams(pieces: DataFrame, n: int, *, key: str = "key", seq: str = "seq", payload: str = "payload", whole: int = 4_000_000, scratch: Scratch | None = None) -> DataFrame:
    """(key, distinct_grams, observations, most): how many n-grams whole payloads have, each once and all, and how often the most
    frequent one stands there, from their pieces.

    The pieces of a payload of up to ``whole`` bytes meet in one task, so no more than they is shuffled. Those of a longer
    one are counted where they are, with what stands before them, and its counts are dealt by gram.
    """
    from bytelens.operators.histograms import ngram_histogram

    ship(pieces.sparkSession)
    scratch = scratch or Scratch(pieces.sparkSession)
    long = scratch.save(pieces.groupBy(F.col(key).alias("_k")).agg(F.sum(F.length(payload)).alias("_n")).where(F.col("_n") > whole).select("_k"))
    count = long.count()
    named = F.broadcast(long) if count <= 1_000_000 else long
    cut = lambda how: pieces.join(named, F.col(key).eqNullSafe(F.col("_k")), how) if count else pieces
    kind = pieces.schema[key].dataType.simpleString()
    few = cut("left_anti").select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(payload).alias("payload"))
    few = few.repartition("key").sortWithinPartitions("key", "seq").select("key", "payload")
    out = few.mapInArrow(_counted(n), f"key {kind}, distinct_grams long, observations long, most long")
    if count:
        h = ngram_histogram(with_context(cut("left_semi"), n, key=key, seq=seq, payload=payload, scratch=scratch), F.col(payload), n, [key])
        out = out.union(h.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("distinct_grams"), F.sum("cnt").alias("observations"), F.max("cnt").alias("most")))
    return out.withColumnRenamed("key", key)


def fold_pieces(pieces: DataFrame, leaf: Callable[[bytes], bytes], combine: Callable[[bytes, bytes], bytes], *, key: str = "key", seq: str = "seq", payload: str = "payload", fan: int = 256) -> DataFrame:
    """(key, state): the fold of each key's pieces in order of seq, a whole number from 0; combine need only be associative.

    Each level combines runs of ``fan`` neighbours, so a task holds one state and no key is one task's. Null pieces are
    empty. The driver learns the greatest seq.
    """
    ship(pieces.sparkSession)
    kind = pieces.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, _seq long, _state binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [leaf(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.binary())], [key, "_seq", "_state"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, b""
        for batch in batches:
            out = []
            for k, s, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (k, s // fan)
                if group == now:
                    state = combine(state, x)
                else:
                    if now is not None:
                        out.append((*now, state))
                    now, state = group, x
            yield rows(out, batch.schema)
            schema_ = batch.schema
        if now is not None:
            yield rows([(*now, state)], schema_)

    def rows(out: list, schema_: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema_.field(i).type) for i in range(3)], schema_.names)

    top = pieces.agg(F.max(seq)).first()[0] or 0
    states = pieces.select(F.col(key), F.col(seq).cast("long").alias("_seq"), F.col(payload)).mapInArrow(first, schema)
    while True:
        group = F.floor(F.col("_seq") / fan)
        states = states.repartition(F.col(key), group).sortWithinPartitions(F.col(key), "_seq").mapInArrow(level, schema)
        top //= fan
        if top == 0:
            return states.select(key, F.col("_state").alias("state"))


# Runs of equal bytes -----------------------------------------------------------------------------

#: Bytes; the byte and length of the first run and of the last one; transitions; of the runs between those two the longest, how many have 4 bytes or more, and their bytes.
_RUNS = struct.Struct("<QBQBQQQQQ")


def runs_leaf(raw: bytes) -> bytes:
    if not raw:
        return _RUNS.pack(*[0] * 9)
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(b[1:] != b[:-1])
    n = np.diff(np.r_[-1, edge, len(b) - 1])
    between = n[1:-1]
    long = between[between >= 4]
    return _RUNS.pack(len(b), raw[0], int(n[0]), raw[-1], int(n[-1]), len(edge), int(between.max(initial=0)), len(long), int(long.sum()))


def runs_combine(a: bytes, b: bytes) -> bytes:
    x, y = _RUNS.unpack(a), _RUNS.unpack(b)
    if not x[0] or not y[0]:
        return b if not x[0] else a
    (n, first, head, last, tail, turns, top, some, held), (m, first2, head2, last2, tail2, turns2, top2, some2, held2) = x, y
    closed = []  # runs that neither border can touch any more
    if last == first2:
        if turns and turns2:
            closed = [tail + head2]
        head = head if turns else head + head2
        tail2 = tail2 if turns2 else tail + tail2
        turns += turns2
    else:
        closed = [tail] * bool(turns) + [head2] * bool(turns2)
        turns += turns2 + 1
    long = [r for r in closed if r >= 4]
    return _RUNS.pack(n + m, first, head, last2, tail2, turns, max([top, top2, *closed]), some + some2 + len(long), held + held2 + sum(long))


def runs_total(state: bytes) -> tuple[int, int, int, int, int]:
    """(bytes, transitions, longest run, runs of 4 and more, bytes in those)."""
    n, _, head, _, tail, turns, top, some, held = _RUNS.unpack(state)
    ends = [head, tail] if turns else [head] if n else []
    long = [r for r in ends if r >= 4]
    return n, turns, max([top, *ends]), some + len(long), held + sum(long)


def piece_runs(pieces: DataFrame, **options) -> DataFrame:
    """(key, total, transitions, longest_run, runs_ge4, bytes_in_runs) of whole payloads from their pieces."""
    from bytelens.functions.columns import run_totals

    folded = fold_pieces(pieces, runs_leaf, runs_combine, **options)
    return folded.select(*[c for c in folded.columns if c != "state"], run_totals(F.col("state")).alias("r")).select(*[c for c in folded.columns if c != "state"], "r.*")
