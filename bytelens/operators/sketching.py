"""Sketches over groups: built in Arrow batches, merged by Spark's aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from bytelens.functions import hashes, lockstep, sketches
from bytelens.scratch import Scratch
from bytelens.session import ship


def hll_registers(df: DataFrame, item: Column, p: int = 12, by: list[str] | None = None) -> DataFrame:
    """(by..., idx, rank): the largest rank of each register that any item reaches; merging is taking the larger."""
    by = by or []
    h = F.col("_h")
    rest = F.shiftleft(h, p)
    # The position of the highest bit of 64: by the length of the binary form, which has no leading zeros.
    zeros = F.when(rest == 0, F.lit(64 - p)).otherwise(64 - F.length(F.bin(rest)))
    from bytelens.functions.columns import mix64

    rows = df.select(*by, mix64(item, sketches.HLL_SEED).alias("_h")).where("_h IS NOT NULL")
    return rows.select(*by, F.shiftrightunsigned(h, 64 - p).alias("idx"), (zeros + 1).alias("rank")).groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 12, by: list[str] | None = None) -> DataFrame:
    by = by or []
    m = 1 << p
    n, s = F.count("*"), F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    g = registers.groupBy(*by).agg(n.alias("n"), s.alias("s"))
    raw = F.lit(sketches.hll_alpha(m) * m * m) / (F.col("s") + (m - F.col("n")))
    zeros = m - F.col("n")
    full = 2.0**32
    large = F.when((raw > full / 30) & (raw < full), -full * F.ln(1 - raw / full)).otherwise(raw)
    whole = F.when((raw <= 2.5 * m) & (zeros > 0), m * F.ln(m / zeros)).otherwise(large)
    return g.select(*by, F.floor(whole + 0.5).cast("long").alias("estimate"))


def count_min(df: DataFrame, item: Column, rows: int = 4, cols: int = 1024, by: list[str] | None = None) -> DataFrame:
    """(by..., row, cell, cnt) of 32-bit items."""
    ship(df.sparkSession)
    by = by or []

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_item").to_numpy(zero_copy_only=False).astype(np.uint32)
            c = sketches.count_min_cells(x, rows, cols)
            cols_ = [batch.column(k).take(pa.array(np.tile(np.arange(len(x)), rows))) for k in by]
            yield pa.RecordBatch.from_arrays([*cols_, pa.array(np.repeat(np.arange(rows, dtype=np.int32), len(x))), pa.array(c.reshape(-1)), batch.column("_n").take(pa.array(np.tile(np.arange(len(x)), rows)))], [*by, "row", "cell", "n"])

    # Items are counted first, so a frequent one is hashed once for each task.
    n = df.select(*by, item.cast("long").alias("_item")).where("_item IS NOT NULL").groupBy(*by, "_item").agg(F.count("*").alias("_n"))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return n.mapInArrow(cells, kinds + "row int, cell long, n long").groupBy(*by, "row", "cell").agg(F.sum("n").alias("cnt"))


def count_min_estimate(table: DataFrame, items: DataFrame, item: str, rows: int = 4, cols: int = 1024) -> DataFrame:
    """items with the estimate: the least of an item's cells."""
    ship(items.sparkSession)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = sketches.count_min_cells(batch.column(item).to_numpy(zero_copy_only=False).astype(np.uint32), rows, cols)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(item).take(pa.array(np.tile(np.arange(n), rows))), pa.array(np.repeat(np.arange(rows, dtype=np.int32), n)), pa.array(c.reshape(-1))], [item, "row", "cell"])

    kind = items.schema[item].dataType.simpleString()
    at = items.select(item).mapInArrow(cells, f"`{item}` {kind}, row int, cell long")
    return at.join(table, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def heavy_hitters(df: DataFrame, item: Column, k: int, kind: str = "misra_gries") -> DataFrame:
    """(item, low, high): bounds of the counts of the items that k counters hold.

    Each task keeps k counters. misra_gries: counts are too low, by n / (k + 1) at most. space_saving: they are too
    high; a task that is full may have seen an item it doesn't hold as often as its least counter says, so that is
    added for each such task, and what an item took over from another when it came in is taken off below.
    """
    if kind not in ("misra_gries", "space_saving"):
        raise ValueError(kind)
    ship(df.sparkSession)
    if kind == "space_saving":
        return _space_saving(df, item, k)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sketches.MisraGries(k)
        for batch in batches:
            one = sketches.MisraGries(k)
            v, n = np.unique(batch.column("_i").to_numpy(zero_copy_only=False), return_counts=True)
            one.n, one.counts = int(n.sum()), dict(zip(v.tolist(), n.tolist(), strict=True))
            s.merge(one)
        yield pa.RecordBatch.from_arrays([pa.array([list(s.counts)], pa.list_(pa.int64())), pa.array([list(s.counts.values())], pa.list_(pa.int64())), pa.array([s.n])], ["items", "counts", "n"])

    part = df.select(item.cast("long").alias("_i")).where("_i IS NOT NULL").mapInArrow(keep, "items array<long>, counts array<long>, n long")
    part = Scratch(df.sparkSession).save(part)
    flat = part.select(F.explode(F.arrays_zip("items", "counts")).alias("x")).select(F.col("x.items").alias("item"), F.col("x.counts").alias("c"))
    total = part.agg(F.sum("n").alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("held")).first()
    # What is not held in a task was taken off in rounds of k + 1, so a count is low by that much at most.
    lost = ((total["n"] or 0) - (total["held"] or 0)) // (k + 1)
    return flat.groupBy("item").agg(F.sum("c").alias("low")).select("item", "low", (F.col("low") + lost).alias("high"))


def _space_saving(df: DataFrame, item: Column, k: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sketches.SpaceSaving(k)
        for batch in batches:
            v, n = np.unique(batch.column("_i").to_numpy(zero_copy_only=False), return_counts=True)
            for i in np.lexsort((v, -n)).tolist():
                s.update(int(v[i]), int(n[i]))
        floor = min(s.counts) if len(s.items) == k and k else 0
        yield pa.RecordBatch.from_arrays([pa.array(s.items, pa.int64()), pa.array([c - floor for c in s.counts], pa.int64()), pa.array([c - e for c, e in zip(s.counts, s.errors, strict=True)], pa.int64()), pa.array([floor] * len(s.items), pa.int64()), pa.array([i == 0 for i in range(len(s.items))])], ["item", "above", "low", "floor", "first"])

    part = df.select(item.cast("long").alias("_i")).where("_i IS NOT NULL").mapInArrow(keep, "item long, above long, low long, floor long, first boolean")
    part = Scratch(df.sparkSession).save(part)
    floors = part.where("first").agg(F.sum("floor")).first()[0] or 0
    held = part.groupBy("item").agg(F.sum("low").alias("low"), F.sum("above").alias("above"))
    return held.select("item", "low", (F.col("above") + floors).alias("high"))


def bloom_filter(df: DataFrame, item: Column, expected: int, rate: float) -> sketches.Bloom:
    """One filter over all items (binary, or whole numbers as keys): words of each task, joined by OR. Its size is fixed by the parameters."""
    ship(df.sparkSession)
    shape = sketches.Bloom.sized(expected, rate)
    keyed = not isinstance(df.select(item.alias("_i")).schema["_i"].dataType, BinaryType)
    item = item.cast("long") if keyed else item

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sketches.Bloom(shape.bits, shape.hashes)
        for batch in batches:
            there = batch.column("_i").drop_null()
            if keyed:
                b.insert_keys(there.to_numpy(zero_copy_only=False))
            else:
                b.insert_all(*lockstep.flat(there))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(b.words))), pa.array(b.words.view(np.int64)), pa.array(np.r_[b.n, np.zeros(len(b.words) - 1, int)])], ["word", "bits", "n"])

    words = df.select(item.alias("_i")).mapInArrow(fill, "word long, bits long, n long").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    for r in words.collect():
        shape.words[r["word"]] = np.int64(r["bits"]).astype(np.uint64)
        shape.n += r["n"]
    return shape


def bloom_contains(item: Column, bloom: sketches.Bloom) -> Column:
    """Whether the filter may hold the item; null for null."""

    def g(col: pa.Array) -> pa.Array:
        return pa.array(bloom.contains_all(*lockstep.flat(col)), mask=col.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(g, "boolean")(item)


def bloom_contains_key(key: Column, bloom: sketches.Bloom) -> Column:
    """Whether a filter of keys may hold the whole number, a batch at a time; null for null."""

    def g(col: pa.Array) -> pa.Array:
        return pa.array(bloom.contains_keys(col.fill_null(0).to_numpy(zero_copy_only=False)), mask=col.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(g, "boolean")(key.cast("long"))


def ordered_quantile(df: DataFrame, value: str, order: str, p: float, by: list[str]) -> DataFrame:
    """(by..., estimate): the five-marker estimate of each group's values in their order, streamed, not held."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q, out = None, None, []
        for batch in batches:
            for *k, v in zip(*(batch.column(c).to_pylist() for c in (*by, value)), strict=True):
                if k != key:
                    if q:
                        out.append((*key, q.estimate()))
                    key, q = k, sketches.P2Quantile(p)
                q.update(v)
        if q:
            out.append((*key, q.estimate()))
        kinds = [schema.field(c).type for c in by] if (schema := batch_schema.get("s")) else [pa.string()] * len(by)
        cols = list(zip(*out, strict=True)) or [()] * (len(by) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*kinds, pa.float64()], strict=True)], [*by, "estimate"])

    from pyspark.sql.pandas.types import to_arrow_schema

    batch_schema = {"s": to_arrow_schema(df.select(*by).schema)}
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    dealt = df.select(*by, F.col(value).cast("double").alias(value), order).repartition(*by).sortWithinPartitions(*by, order)
    return dealt.select(*by, value).mapInArrow(run, kinds + "estimate double")


def mix_word(v: int) -> int:
    return hashes.signed(hashes.mix_word(v))
