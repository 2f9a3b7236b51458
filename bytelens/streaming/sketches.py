"""Streaming forms of what merges: every state here is a sum or a maximum, so late and reordered rows do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, name: str, *, files_per_trigger: int = 1) -> DataFrame:
    """A table's parquet files as a stream."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def register_maxima(events: DataFrame, idx: Column, rank: Column, by: list[str]) -> DataFrame:
    """HyperLogLog registers as a streaming aggregate."""
    return events.select(*by, idx.alias("idx"), rank.alias("rank")).groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def count_min_cells(events: DataFrame, item: Column, rows: int = 4, cols: int = 1024) -> DataFrame:
    """(row, cell, cnt): a Count-Min table as a streaming sum; items are 32-bit numbers."""
    from bytelens.functions.columns import count_min_places

    at = events.select(F.posexplode(count_min_places(item, rows, cols)).alias("row", "cell"))
    return at.groupBy("row", "cell").agg(F.count("*").alias("cnt"))


def bloom_words(events: DataFrame, item: Column, shape) -> DataFrame:
    """(word, bits): the words of a Bloom filter of the given shape as a streaming OR; items are binary."""
    from bytelens.functions.columns import bloom_places

    at = events.select(F.explode(bloom_places(item, shape)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    return at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def byte_histogram(events: DataFrame, payload: Column, by: list[str]) -> DataFrame:
    """(by..., byte, cnt) as a streaming sum."""
    from bytelens.functions.columns import byte_counts

    flat = events.select(*by, F.posexplode(byte_counts(payload)).alias("byte", "n")).where("n > 0")
    return flat.groupBy(*by, "byte").agg(F.sum("n").alias("cnt"))


def hash_bins(events: DataFrame, payload: Column, n: int, bins: int, by: list[str]) -> DataFrame:
    """(by..., bin, cnt) of hashed n-grams as a streaming sum."""
    from bytelens.functions.columns import ngram_bins

    flat = events.select(*by, F.posexplode(ngram_bins(payload, n, bins)).alias("bin", "n")).where("n > 0")
    return flat.groupBy(*by, "bin").agg(F.sum("n").alias("cnt"))


def minhash_slots(events: DataFrame, elements: Column, by: list[str], k: int, seed: int) -> DataFrame:
    """(by..., slot, v): the least of each slot as a streaming minimum, with the highest bit flipped so that signed order is unsigned order."""
    from bytelens.operators.content import minhash

    low = F.lit(-(1 << 63)).cast("long")
    flat = events.select(*by, F.posexplode(minhash(elements, k, seed)).alias("slot", "v")).where("v IS NOT NULL")
    return flat.groupBy(*by, "slot").agg(F.min(F.col("v").bitwiseXOR(low)).alias("v"))


def run_once(stream: DataFrame, mode: str, checkpoint: str, sink: str) -> None:
    """Drain what is there into a Parquet table: append adds each batch, complete puts the whole result in its place."""
    if mode not in ("append", "complete"):
        raise ValueError(mode)
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "complete":
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink))
    else:
        w = w.format("parquet").option("path", sink)
    w.start().awaitTermination()
