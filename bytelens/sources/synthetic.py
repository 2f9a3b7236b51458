"""Made-up payloads with known structure, for tests and trials: a row says which kind it is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.session import ship

KINDS = ("zeros", "runs", "period", "few", "text", "random", "sparse")
_LETTERS = np.frombuffer(b"etaoinshrdlu    \n.,", np.uint8)


def payload(kind: str, size: int, seed: int) -> bytes:
    rng = np.random.default_rng(seed)
    if kind == "zeros":
        out = np.zeros(size, np.uint8)
    elif kind == "runs":
        out = np.repeat(rng.integers(0, 256, size // 8 + 1), 8)[:size]
    elif kind == "period":
        out = np.resize(rng.integers(0, 256, 64), size)
    elif kind == "few":
        out = rng.choice(rng.integers(0, 256, 12), size)
    elif kind == "text":
        out = rng.choice(_LETTERS, size)
    elif kind == "sparse":
        out = np.where(rng.random(size) < 0.02, rng.integers(1, 256, size), 0)
    else:
        out = rng.integers(0, 256, size)
    return out.astype(np.uint8).tobytes()


def corpus(spark: SparkSession, rows: int, *, size: int = 4096, kinds: tuple[str, ...] = KINDS, seed: int = 1) -> DataFrame:
    """(id, kind, payload): the same rows for the same seed, however they are dealt."""
    ship(spark)
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"no kinds {sorted(unknown)}")

    @F.arrow_udf("binary")
    def made(ids: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.array([payload(k, size, seed * 1_000_003 + i) for i, k in zip(ids.to_pylist(), kind.to_pylist(), strict=True)], pa.binary())

    named = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(rows).withColumn("kind", named).withColumn("payload", made("id", "kind"))


def vectors(spark: SparkSession, rows: int, *, dim: int = 32, clusters: int = 8, spread: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, cluster, vector): points around centers, the id's remainder naming its center."""
    ship(spark)
    centers = np.random.default_rng(seed).normal(size=(clusters, dim))

    @F.arrow_udf("array<double>")
    def made(ids: pa.Array) -> pa.Array:
        out = [(centers[i % clusters] + np.random.default_rng(seed * 1_000_003 + i).normal(size=dim) * spread).tolist() for i in ids.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return spark.range(rows).withColumn("cluster", F.col("id") % clusters).withColumn("vector", made("id"))
