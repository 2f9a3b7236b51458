"""Counts of many byte patterns over a column, in one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.functions import lockstep
from bytelens.functions.automaton import automaton
from bytelens.session import ship


def pattern_hits(df: DataFrame, payload: Column, patterns: DataFrame, *, most: int = 100_000) -> DataFrame:
    """(pattern binary, n_payloads, hits): of patterns (pattern binary), each once, in how many payloads they stand and how often.

    Overlapping matches count each. Every task sends a row for each pattern that it met. The automaton is a table of about a
    kilobyte for each byte of the patterns, so more than ``most`` patterns raise. Null payloads have no matches; patterns
    that are null or empty count for nothing.
    """
    ship(df.sparkSession)
    named = patterns.where("pattern IS NOT NULL AND octet_length(pattern) > 0").select(F.col("pattern").cast("binary").alias("pattern")).distinct().limit(most + 1)
    known = tuple(sorted(bytes(r["pattern"]) for r in named.collect()))
    if len(known) > most:
        raise ValueError(f"more than {most} patterns")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(known)
        docs, hits = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            raw, at = lockstep.flat(batch.column(0))
            for a, b in lockstep.slices(at, 4_000_000):
                doc, _, number = machine.scan(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                hits += np.bincount(number, minlength=len(known))
                docs += np.bincount(np.unique(doc * len(known) + number) % len(known), minlength=len(known))
        met = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(docs[met]), pa.array(hits[met])], ["k", "d", "h"])

    found = df.select(payload.alias("_p")).mapInArrow(count, "k long, d long, h long").groupBy("k").agg(F.sum("d").alias("n_payloads"), F.sum("h").alias("hits"))
    names = df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(known)], "k long, pattern binary")
    out = names.join(found, "k", "left")
    return out.select("pattern", F.coalesce("n_payloads", F.lit(0)).cast("long").alias("n_payloads"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
