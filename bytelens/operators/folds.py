"""Folds: a leaf function of pieces of payloads and an associative combination with an identity.

Where the combination is a sum, a minimum or a maximum, Spark's partial aggregates are the fold. ``fold`` takes any
other: leaves and partial results are made in Arrow batches and combined in a tree of groups of fixed fan-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.session import ship


def split_fold(raw: bytes, leaf: Callable, combine: Callable, identity, size: int, split_at: Callable[[int], int] = lambda n: n // 2):
    """Of one payload: split down to pieces of ``size`` bytes at most, combined on the way back.

    split_at says for a length where to split; a place outside the inner ones makes the piece a leaf.
    """
    if not raw:
        return identity
    at = split_at(len(raw))
    if len(raw) <= size or not 0 < at < len(raw):
        return leaf(raw)
    return combine(split_fold(raw[:at], leaf, combine, identity, size, split_at), split_fold(raw[at:], leaf, combine, identity, size, split_at))


def min_max_len(df: DataFrame, payload: Column, by: list[str]) -> DataFrame:
    """(by..., low, high, n_bytes); 255, 0 and 0 where there are no bytes."""
    from bytelens.functions.columns import byte_counts

    c = df.select(*by, byte_counts(payload).alias("c"), F.length(payload).alias("n"))
    there = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at("c", i + 1) > 0)
    low, high = F.coalesce(F.array_min(there), F.lit(255)), F.coalesce(F.array_max(there), F.lit(0))
    return c.groupBy(*by).agg(F.min(low).alias("low"), F.max(high).alias("high"), F.sum(F.coalesce("n", F.lit(0))).alias("n_bytes"))


def leaf_count(df: DataFrame, payload: Column, size: int, by: list[str]) -> DataFrame:
    """(by..., leaves): pieces that halving makes until none is over ``size``."""
    return df.select(*by, F.length(payload).alias("n")).groupBy(*by).agg(F.sum(_leaves(F.col("n"), size)).alias("leaves"))


def _leaves(n: Column, size: int) -> Column:
    """Halving n bytes makes pieces of two neighbouring lengths at each depth; how many there are at the first depth
    where the longer fits, and where only the shorter does, fixes the count."""
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(n / size))))
    parts = F.pow(F.lit(2.0), depth).cast("long")
    above = F.greatest(F.lit(1), (parts / 2).cast("long"))
    longer = n % above
    # One depth up, pieces have floor(n / above) or one more byte; those that fit stay whole.
    short = F.floor(n / above) <= size
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.when(short, above + longer).otherwise(parts)).cast("long")


def fold(df: DataFrame, payload: Column, leaf: Callable[[bytes], bytes], combine: Callable[[bytes, bytes], bytes], identity: bytes, *, fan: int = 64) -> bytes:
    """The fold of all payloads of df, whose states are byte strings; the combination must not mind the order.

    A null payload counts as the identity. Each level combines groups of ``fan`` partial results.
    """
    ship(df.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = identity
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                state = combine(state, leaf(raw)) if raw is not None else state
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["state"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = identity
        for batch in batches:
            for x in batch.column(0).to_pylist():
                state = combine(state, x)
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["state"])

    part = df.select(payload.alias("p")).mapInArrow(first, "state binary")
    n = part.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        # A shuffle of the few states: coalescing would carry the leaves' own pass into as few tasks.
        part = part.repartition(n).mapInArrow(again, "state binary")
    state = identity
    for r in part.collect():  # `fan` states at most
        state = combine(state, bytes(r["state"]))
    return state


def add_histograms(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()
