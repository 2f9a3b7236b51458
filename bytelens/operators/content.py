"""Datasets of payloads: signatures for near-duplicates, chunk dedup, orders and the composed build plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from bytelens.functions import columns as fc
from bytelens.functions import hashes, lockstep, orders, similar
from bytelens.functions.chunking import ChunkSizes
from bytelens.scratch import Scratch, ordered
from bytelens.session import ship


def minhash(elements: Column, k: int, seed: int, kind: str = "classic") -> Column:
    """Slots (longs, null where unpopulated) of an array of strings: classic, one_permutation or densified."""

    @arrow_udf("array<bigint>")
    def f(col: pa.Array) -> pa.Array:
        out = []
        size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, int)
        size = np.where(col.is_valid().to_numpy(zero_copy_only=False), size, 0)
        flat = col.flatten()
        h = hashes.mix64_all(*lockstep.flat(flat.cast(pa.binary())), seed)
        there_, ends = flat.is_valid().to_numpy(zero_copy_only=False), np.cumsum(size)
        for i, known in enumerate(col.is_valid().to_pylist()):
            if not known:
                out.append(None)
                continue
            own = slice(ends[i] - size[i], ends[i])
            e = h[own][there_[own]]
            slots, there = similar.minhash(e, k, seed) if kind == "classic" else similar.one_permutation(e, k, seed)
            if kind == "densified":
                slots, there = similar.densify(slots, there)
            out.append([int(s) if t else None for s, t in zip(slots.view(np.int64), there, strict=True)])
        return pa.array(out, pa.list_(pa.int64()))

    return f(elements)


def minhash_bands(slots: Column, bands: int) -> Column:
    """An array of band keys; null for an unpopulated signature."""

    @arrow_udf("array<bigint>")
    def f(col: pa.Array) -> pa.Array:
        return pa.array([None if s is None or None in s else similar.band_keys(np.array(s, np.int64).view(np.uint64), bands).view(np.int64) for s in col.to_pylist()], pa.list_(pa.int64()))

    return f(slots)


def merged_minhash(df: DataFrame, elements: Column, by: list[str], k: int, seed: int) -> DataFrame:
    """(by..., slots) of the union of each group's sets: the least of each slot, as unsigned numbers. Groups without elements have none.

    Each row's signature stands for itself, so a stream of rows merges by the same aggregate.
    """
    low = F.lit(-(1 << 63)).cast("long")
    flat = df.select(*by, F.posexplode(minhash(elements, k, seed)).alias("slot", "v")).where("v IS NOT NULL")
    least = flat.groupBy(*by, "slot").agg(F.min(F.col("v").bitwiseXOR(low)).alias("v"))
    slots = least.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("s"))
    return slots.select(*by, F.transform("s", lambda x: x["v"].bitwiseXOR(low)).alias("slots"))


def minhash_jaccard(a: Column, b: Column) -> Column:
    """Equal slots of those that either has; 0 without any."""
    start = F.struct(F.lit(0).alias("eq"), F.lit(0).alias("n"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.eqNullSafe(y).alias("same"), (x.isNotNull() | y.isNotNull()).alias("any")))
    step = lambda s, p: F.struct((s["eq"] + (p["same"] & p["any"]).cast("int")).alias("eq"), (s["n"] + p["any"].cast("int")).alias("n"))
    return F.aggregate(pairs, start, step, lambda s: F.when(s["n"] == 0, 0.0).otherwise(s["eq"] / s["n"]))


def b_bit_jaccard(a: Column, b: Column, bits: int) -> Column:
    cut = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    chance = 2.0**-bits
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (minhash_jaccard(cut(a), cut(b)) - chance) / (1 - chance)))


def simhash(elements: Column) -> Column:
    """64 bits over the xxhash64 of an array of strings, without leaving the JVM."""
    h = F.transform(elements, lambda x: F.xxhash64(x))
    bit = lambda i: F.aggregate(h, F.lit(0), lambda s, x: s + F.when(F.getbit(x, i) == 1, 1).otherwise(-1))
    places = F.sequence(F.lit(0), F.lit(63))
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(bit(i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def chunk_rows(df: DataFrame, payload: Column, sizes: ChunkSizes, keep: list[str]) -> DataFrame:
    """(keep..., start, end, digest) of every content-defined chunk; a payload leaves its task only as digests."""
    cut = df.select(*keep, payload.alias("_p")).withColumn("_c", fc.chunks(F.col("_p"), sizes)).select(*keep, "_p", F.explode("_c").alias("c"))
    piece = F.substring(F.col("_p"), (F.col("c.start") + 1).cast("int"), (F.col("c.end") - F.col("c.start")).cast("int"))
    return cut.select(*keep, F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.sha2(piece, 256).alias("digest"))


def chunk_dedup(chunks: DataFrame) -> DataFrame:
    """(digest, copies, size): what each distinct chunk costs and saves."""
    return chunks.groupBy("digest").agg(F.count("*").alias("copies"), F.first(F.col("end") - F.col("start")).alias("size"))


def chunk_quality(chunks: DataFrame, sizes: ChunkSizes, by: list[str]) -> DataFrame:
    n = F.col("end") - F.col("start")
    low, high = (n < sizes.min_size).cast("double"), (n > sizes.max_size).cast("double")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(n).alias("total_bytes"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.avg(low).alias("below_min_fraction"), F.avg(high).alias("above_max_fraction"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Places in a global order. The dealt ranges are a written table, so a lost executor can't change them."""
    return ordered(df, [F.col(c) for c in order], Scratch(df.sparkSession), pos=name)


def hilbert_order(df: DataFrame, id_col: str, vector: Column, dim: int, bits: int = 16) -> DataFrame:
    """(id, new_id) along a Hilbert curve through the vectors' grid, ties by id."""
    ship(df.sparkSession)
    v = df.select(F.col(id_col).alias("id"), vector.alias("v"))
    finite = lambda i: F.when(~F.isnan(F.col("v")[i]) & (F.abs(F.col("v")[i]) < float("inf")), F.col("v")[i])
    r = v.agg(*[f(finite(i)).alias(f"{n}{i}") for i in range(dim) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = np.array([r[f"lo{i}"] or 0.0 for i in range(dim)])
    high = np.array([r[f"hi{i}"] if r[f"hi{i}"] is not None else low[i] for i in range(dim)])

    @arrow_udf("binary")
    def key(col: pa.Array) -> pa.Array:
        x = np.array([[np.nan if y is None else y for y in row] for row in col.to_pylist()], np.float32).reshape(-1, dim)
        return pa.array(orders.hilbert_keys(orders.quantize(x, low, high, bits), bits), pa.binary())

    return numbered(v.select("id", key(F.col("v")).alias("k")), ["k", "id"], "new_id").select("id", "new_id")


def hilbert_points(df: DataFrame, id_col: str, x: Column, y: Column, bits: int = 16) -> DataFrame:
    """(id, new_id) along a Hilbert curve through points of the plane, ties by id."""
    return hilbert_order(df, id_col, F.array(x.cast("double"), y.cast("double")), 2, bits)


def graph_order(edges: DataFrame, kind: str = "rcm", *, most: int = 2_000_000) -> DataFrame:
    """(id, new_id) of a graph (src, dst) whose order is a sequence of dependent steps, so one task takes it.

    kind: rcm or community. A graph of more than ``most`` distinct edges raises: cut it into components first.
    """
    ship(edges.sparkSession)
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    if e.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for batch in batches for p in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        names = sorted({x for p in pairs for x in p})
        at = {x: i for i, x in enumerate(names)}
        local = [(at[a], at[b]) for a, b in pairs]
        place = orders.inverse(orders.rcm(len(names), local)) if kind == "rcm" else orders.communities(len(names), local)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(place, pa.int64())], ["id", "new_id"])

    return e.coalesce(1).sortWithinPartitions("a", "b").mapInArrow(one, "id long, new_id long")


def large_graph_order(edges: DataFrame, kind: str = "rcm", *, most: int = 2_000_000) -> DataFrame:
    """As ``graph_order`` of a graph of any size: one of more than ``most`` distinct edges is ordered in rounds of joins.

    rcm is the same order then. communities of a large graph merge many at a time (see ``communities``), which is another
    order than merging one by one gives; a vertex that has only itself for a neighbour stands behind all others.
    """
    from bytelens.operators import communities, graphs

    scratch = Scratch(edges.sparkSession)
    e = scratch.save(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    if e.count() <= most:
        return graph_order(e, kind, most=most)
    if kind == "rcm":
        return graphs.rcm_levels(e, scratch)
    out = communities.communities(e, scratch).select("id", "new_id")
    alone = e.where("src = dst").select(F.col("src").alias("id")).join(out.select("id"), "id", "left_anti")
    n = out.count()
    return out.union(ordered(alone, [F.col("id")], scratch).select("id", F.col("pos") + n))


def graph_bandwidth(edges: DataFrame, order: DataFrame) -> DataFrame:
    a, b = order.select(F.col("id").alias("src"), F.col("new_id").alias("x")), order.select(F.col("id").alias("dst"), F.col("new_id").alias("y"))
    return edges.join(a, "src").join(b, "dst").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("bandwidth"))


def build_plan(df: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """Per payload: fingerprint, hint, format and content id, in one pass over it."""
    p = df.select(F.col(id_col).alias("id"), payload.alias("_p"))
    return p.select("id", F.length("_p").alias("n_bytes"), fc.extent_fingerprint(F.col("_p")).alias("fp"), fc.representation_hint(F.col("_p")).alias("hint"), fc.detect_format(F.col("_p")).alias("fmt"), fc.sha256_cid(F.col("_p")).alias("cid")).select("id", "n_bytes", "fp.*", "hint", F.col("fmt.format").alias("format"), "cid")
