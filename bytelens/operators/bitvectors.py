"""Rank and select of long bit vectors by a stored directory.

A vector is a table of 64-bit words. Its directory has a row for each block of 4,096 bits, with the ones before it, summed first
over superblocks of 4,096 blocks, so no task sums a whole vector. Every SAMPLE-th one points to the blocks that can hold it. A
rank is one look-up, a select one among at most SAMPLE blocks; both count inside a single block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SUPER, SAMPLE = 4096, 4096, 64


def packed_words(bits: DataFrame, key: list[str], pos: str = "pos", bit: str = "bit") -> DataFrame:
    """(key, word_no, word) of every word up to the last place named in bits (key, pos long, bit 0 or 1); places not named are 0.

    Words are packed in each task before they are shuffled. Null and negative places count for nothing.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(pos, F.lit(64)).cast("int"))
    known = bits.where(F.col(pos) >= 0).select(*key, F.floor(F.col(pos) / 64).alias("word_no"), F.when(F.col(bit) == 1, one).otherwise(F.lit(0).cast("long")).alias("_w"))
    some = known.groupBy(*key, "word_no").agg(F.bit_or("_w").alias("word"))
    # Words that no place names are zeros; a superblock's are listed where its own are, all others by superblock.
    wide = BLOCK // 64 * SUPER
    last = some.groupBy(*key).agg(F.max("word_no").alias("_last"))
    parts = last.select(*key, "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / wide))).alias("_s"))
    every = parts.select(*key, F.explode(F.sequence(F.col("_s") * wide, F.least(F.col("_last"), (F.col("_s") + 1) * wide - 1))).alias("word_no"))
    return every.join(some, [*key, "word_no"], "left").select(*key, "word_no", F.coalesce("word", F.lit(0).cast("long")).alias("word"))


def directory(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, block, before, ones, words): of each block of a vector given as (key, word_no, word), all words from 0 on."""
    per = BLOCK // 64
    block = F.floor(F.col("word_no") / per)
    rows = words.groupBy(*key, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("w"), F.sum(F.bit_count("word")).alias("ones"))
    rows = rows.select(*key, "block", "ones", F.transform("w", lambda x: x["word"]).alias("words"), F.floor(F.col("block") / SUPER).alias("_s"))
    sums = words.groupBy(*key, F.floor(F.col("word_no") / (per * SUPER)).alias("_s")).agg(F.sum(F.bit_count("word")).alias("_n"))
    run = Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_s", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, [*key, "_s"]).withColumn("before", F.col("_before") + F.coalesce(F.sum("ones").over(inside), F.lit(0)))
    return out.select(*key, "block", "before", "ones", "words")


def _low(word: Column, n: Column) -> Column:
    """The lowest n bits of a word, n from 0 to 63."""
    return word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n)))


def rank_of(queries: DataFrame, held: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """queries with rank1: the ones before the place; null for places beyond the last word."""
    at = queries.withColumn("_b", F.floor(F.col(pos) / BLOCK)).join(held.withColumnRenamed("block", "_b"), [*key, "_b"], "left")
    word = F.floor(F.pmod(pos, F.lit(BLOCK)) / 64).cast("int")
    full = F.aggregate(F.slice("words", F.lit(1), word), F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
    part = F.bit_count(_low(F.get("words", word), F.pmod(pos, F.lit(64)).cast("int")))
    return at.select(*queries.columns, (F.col("before") + full + part).alias("rank1"))


def samples(held: DataFrame, key: list[str]) -> DataFrame:
    """(key, sample, block, before, ones): the blocks that hold any of the ones number SAMPLE * sample and the SAMPLE - 1 after."""
    own = F.sequence(F.floor(F.col("before") / SAMPLE), F.floor((F.col("before") + F.col("ones") - 1) / SAMPLE))
    return held.where("ones > 0").select(*key, F.explode(own).alias("sample"), "block", "before", "ones")


def select_of(queries: DataFrame, held: DataFrame, marks: DataFrame, key: list[str], k: str = "k") -> DataFrame:
    """queries with place: where the k-th one is, from 0; null where there is none. marks are the ``samples`` of held."""
    hit = (F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("ones"))
    asked = queries.withColumn("sample", F.floor(F.col(k) / SAMPLE))
    where = asked.join(marks, [*key, "sample"]).where(hit).select(*queries.columns, "block", "before")
    found = where.join(held.select(*key, "block", "words"), [*key, "block"])
    # The word: go on while ones are left of it; then the place inside.
    start = F.struct((F.col(k) - F.col("before")).cast("long").alias("left"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("word"), F.lit(False).alias("there"))

    def step(s: Column, w: Column) -> Column:
        n = F.bit_count(w).cast("long")
        here = F.struct(s["left"].alias("left"), s["at"].alias("at"), w.alias("word"), F.lit(True).alias("there"))
        on = F.struct((s["left"] - n).alias("left"), (s["at"] + 1).alias("at"), s["word"].alias("word"), F.lit(False).alias("there"))
        return F.when(s["there"], s).when(n > s["left"], here).otherwise(on)

    found = found.withColumn("_s", F.aggregate("words", start, step))
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("_s.word"), i) == 1)
    place = F.col("block") * BLOCK + F.col("_s.at") * 64 + F.get(ones, F.col("_s.left").cast("int"))
    placed = found.select(*key, k, place.cast("long").alias("place")).distinct()
    return queries.join(placed, [*key, k], "left")
