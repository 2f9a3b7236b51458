"""Histograms of groups of payloads: counted in Arrow batches, summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.functions import payload as pl
from bytelens.session import ship


def _partial(keys: int, grams: int):
    """Each batch gives one count for each key and gram in it, so what is shuffled is small."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:keys]
            groups: dict[tuple, list[bytes]] = {}
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is not None:
                    groups.setdefault(tuple(key), []).append(raw)
            ks, gs, ns = [], [], []
            for key, raws in groups.items():
                g = np.concatenate([pl.ngrams(np.frombuffer(r, np.uint8), grams) for r in raws])
                u, n = np.unique(g, return_counts=True)
                ks += [key] * len(u)
                gs.append(u.view(np.int64)), ns.append(n)
            cols = [pa.array([k[i] for k in ks], batch.schema.field(i).type) for i in range(keys)]
            cols += [pa.array(np.concatenate(gs) if gs else [], pa.int64()), pa.array(np.concatenate(ns) if ns else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "gram", "cnt"])

    return count


def ngram_histogram(df: DataFrame, payload: Column, n: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by..., gram, cnt): overlapping n-grams, packed with the first byte lowest, of all payloads of a group."""
    ship(df.sparkSession)
    by = by or []
    rows = df.select(*by, payload.alias("_payload"))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    part = rows.mapInArrow(_partial(len(by), n), kinds + "gram long, cnt long")
    return part.groupBy(*by, "gram").agg(F.sum("cnt").alias("cnt"))


def dense(histogram: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """(by..., counts): an array of all bins for each group of a byte histogram."""
    m = histogram.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("gram", "cnt"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long")))
    return m.select(*by, counts.alias("counts"))


def entropy_of(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bits) of any histogram with cnt."""
    t, c = F.sum("cnt"), F.col("cnt")
    return histogram.groupBy(*by).agg(F.greatest(F.lit(0.0), F.log2(t) - F.sum(c * F.log2(c)) / t).alias("bits"))


def nearest_reference(df: DataFrame, counts: str, references: DataFrame, metric, *, key: str = "label", most: int = 4096) -> DataFrame:
    """df with ``nearest`` and ``distance``: the reference of least distance, the first by label of equals.

    References are a dimension: more than ``most`` of them raise, so what is sent to every task is bounded.
    """
    refs = references.select(key, "counts").orderBy(key).limit(most + 1).collect()
    if len(refs) > most:
        raise ValueError(f"more than {most} references")
    schema = f"array<struct<`{key}`:{references.schema[key].dataType.simpleString()},counts:array<bigint>>>"
    table = df.sparkSession.createDataFrame([([(r[key], list(r["counts"])) for r in refs],)], f"_refs {schema}")
    best = F.array_min(F.transform("_refs", lambda r: F.struct(F.coalesce(metric(F.col(counts), r["counts"]), F.lit(float("inf"))).alias("d"), r[key].alias("n"))))
    return df.join(F.broadcast(table)).withColumn("_b", best).select(*df.columns, F.col("_b.n").alias("nearest"), F.col("_b.d").alias("distance"))
