"""Repeated runs of lines, found in a suffix array of line numbers and deleted but for the first copy.

Lines that stand in the corpus once end every run, so only stretches of repeated lines are sorted. Prefix doubling
ranks the suffixes of those stretches by their first 1, 2, 4, ... lines: a level's rank is the order of a pair of
ranks of the level before, by one distributed sort of the distinct pairs. Equal ranks of a level are an interval of the
suffix array whose longest common prefix has that many lines. Two ranks name a run of any length, so the
intervals of all shortest runs with enough words follow by one grouping; the least place in each is the
first copy.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch, ordered

_WORD = r"[^\x20\x09-\x0D]+"


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _text_key(F.col(text_col)).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("ln", "line"))
    # Two hashes of 64 bits: lines are told apart by 128.
    return d.select("id", "th", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), F.regexp_count("line", F.lit(_WORD)).cast("long").alias("words"))


def _levels(places: DataFrame, longest: int, scratch: Scratch) -> Iterator[tuple[int, DataFrame]]:
    """places: (pos, rem, h1, h2) -> (2^k, table (pos, rank)) for each k: suffixes whose first 2^k lines are repeated.

    rem: lines from pos to the end of its stretch. Doubling ends where it passes ``longest`` lines, or where no such
    prefix is repeated. A table is gone when the next one is asked for.
    """
    names = places.groupBy("h1", "h2").count().where("count > 1")
    names = ordered(names, [F.col("h1"), F.col("h2")], scratch, pos="rank").select("h1", "h2", "rank")
    level, size = scratch.save(places.join(names, ["h1", "h2"]).select("pos", "rem", "rank")), 1
    while True:
        yield size, level
        if 2 * size > longest:
            return
        longer = level.where(F.col("rem") >= 2 * size)
        tail = level.select((F.col("pos") - size).alias("pos"), F.col("rank").alias("then"))
        pairs = scratch.save(longer.join(tail, "pos").select("pos", "rem", "rank", "then"))
        again = pairs.groupBy("rank", "then").count().where("count > 1").drop("count")
        named = ordered(again, [F.col("rank"), F.col("then")], scratch, pos="new")
        new = scratch.save(pairs.join(named, ["rank", "then"]).select("pos", "rem", F.col("new").alias("rank")))
        scratch.drop(level, pairs)
        scratch.release()
        level, size = new, 2 * size
        if not level.take(1):
            return


def repeated_runs(docs: DataFrame, *, min_words: int = 45, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, th, ranges): for each document with lines to delete, their ranges (a, b), inclusive, from 0.

    A line goes if it is in a run of lines with ``min_words`` words at least that also stands earlier, by id (null
    first), then line. Where copies overlap, what the first copy covers stays. Rows equal in id and text
    are one document. th: a hash of the text.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    lines = _lines(docs, id_col, text_col)
    # Written, so that the join deals both sides anew and can split a line that a large share of the rows has.
    many = scratch.save(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    active = lines.join(many, ["h1", "h2"]).dropDuplicates(["id", "th", "ln"])
    # Stretches of repeated lines; one without enough words has no run that counts.
    doc = Window.partitionBy("id", "th")
    active = active.withColumn("stretch", F.col("ln") - F.row_number().over(doc.orderBy("ln")))
    whole = Window.partitionBy("id", "th", "stretch")
    active = active.withColumn("sum", F.sum("words").over(whole)).where(F.col("sum") >= min_words)
    run = whole.orderBy("ln")
    up = run.rowsBetween(Window.unboundedPreceding, 0)
    active = active.withColumn("up", F.sum("words").over(up)).withColumn("rem", (F.max("ln").over(whole) - F.col("ln") + 1).cast("long")).withColumn("nth", F.row_number().over(run))
    placed = ordered(active.drop("sum"), [F.col("id").asc_nulls_first(), F.col("th"), F.col("ln")], scratch)
    placed = scratch.save(placed)
    if not placed.take(1):
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, th long, ranges array<struct<a:int,b:int>>")
    # The shortest run with enough words from each line on, and the shortest up to each line: together they cover
    # every longer run. `up` grows along a stretch, so both ends come from a merge of two sorted columns.
    runs = scratch.save(_forward(placed, min_words).union(_backward(placed, min_words)).distinct())
    longest = runs.agg(F.max("n")).first()[0] or 0
    found = []
    for size, level in _levels(placed.select("pos", "rem", "h1", "h2"), longest, scratch):
        # Two ranks, of the first and of the last `size` lines, name a run of `size` to 2 * `size` - 1 lines.
        mine = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        r = level.select("pos", "rank")
        x = mine.join(r, "pos").withColumn("tail", F.col("pos") + F.col("n") - size).join(r.select(F.col("pos").alias("tail"), F.col("rank").alias("then")), "tail")
        x = x.select("pos", "n", "rank", "then")
        least = x.groupBy("n", "rank", "then").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        later = x.join(least, ["n", "rank", "then"]).where("pos > first").select(F.greatest(F.col("pos"), F.col("first") + F.col("n")).alias("a"), (F.col("pos") + F.col("n") - 1).alias("b")).where("a <= b")
        found.append(scratch.save(later.groupBy("a").agg(F.max("b").alias("b"))))
    covered = found[0]
    for x in found[1:]:
        covered = covered.union(x)
    covered = covered.groupBy("a").agg(F.max("b").alias("b"))
    # Which lines are covered: the furthest end of the runs that begin at or before each, along its stretch.
    w = Window.partitionBy("id", "th", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.join(covered.withColumnRenamed("a", "pos"), "pos", "left").withColumn("far", F.max("b").over(w)).where(F.col("far") >= F.col("pos"))
    island = Window.partitionBy("id", "th").orderBy("ln")
    at = at.withColumn("i", F.col("ln") - F.row_number().over(island))
    ranges = at.groupBy("id", "th", "i").agg(F.min("ln").alias("a"), F.max("ln").alias("b"))
    out = scratch.save(ranges.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges")))
    scratch.release()
    return out


def _forward(placed: DataFrame, min_words: int) -> DataFrame:
    """The shortest run from each line on with enough words."""
    begin = placed.select("id", "th", "stretch", F.lit(1).alias("kind"), (F.col("up") - F.col("words") + min_words).alias("v"), "pos")
    reach = placed.select("id", "th", "stretch", F.lit(0).alias("kind"), F.col("up").alias("v"), "pos")
    own = Window.partitionBy("id", "th", "stretch").orderBy(F.desc("v"), F.desc("pos"), "kind")
    # Of falling v, the last line end seen before a beginning is the first whose sum reaches it.
    x = reach.union(begin).withColumn("end", F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("kind = 1 AND end >= pos").select("pos", (F.col("end") - F.col("pos") + 1).alias("n"))


def _backward(placed: DataFrame, min_words: int) -> DataFrame:
    """The shortest run up to each line with enough words."""
    reach = placed.select("id", "th", "stretch", F.lit(1).alias("kind"), (F.col("up") - min_words).alias("v"), "pos")
    start = placed.select("id", "th", "stretch", F.lit(0).alias("kind"), (F.col("up") - F.col("words")).alias("v"), "pos")
    own = Window.partitionBy("id", "th", "stretch").orderBy("v", "kind", "pos")
    # Of rising v, the last beginning seen has at most `up - min_words` words before it.
    x = reach.union(start).withColumn("begin", F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("kind = 1 AND begin IS NOT NULL AND begin <= pos").select(F.col("begin").alias("pos"), (F.col("pos") - F.col("begin") + 1).alias("n"))


def dedup_lines(docs: DataFrame, *, min_words: int = 45, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without the later copies of repeated runs of lines, and n_lines, n_removed (longs) and removed (ranges).

    A document that loses all its lines stays, with an empty text. Null texts stay null and have no lines; extra
    columns come through, but for such as have one of the three new names; very long texts are edited whole;
    repeated rows are edited alike; no rows give none.
    """
    runs = repeated_runs(docs, min_words=min_words, id_col=id_col, text_col=text_col, scratch=scratch)
    # The row travels as one struct, so no column of docs can have the name of one that is made here.
    runs = runs.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("ranges").alias("removed"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"), _text_key(F.col(text_col)).alias("_key"))
    j = d.join(runs.hint("shuffle_hash"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th")), "left")
    text = F.col("_row")[text_col]
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x, i: ~F.exists("removed", lambda r: (i >= r["a"]) & (i <= r["b"])))
    gone = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0).cast("long"))
    new = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    keep = [new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    return j.select(*keep, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), gone.alias("n_removed"), "removed")
