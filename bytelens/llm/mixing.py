"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be repeated ``target / source_size`` times, a number that is seldom whole.
The whole part is given to all. The fractions are rounded together: two documents at a time, a random amount
of words moves from one to the other so that the source's expected words stay exactly as they are, until one of
the two fractions is 0 or 1; the other goes on to meet the next. Each group leaves one open fraction, and groups
are combined level by level in a tree of fixed fan-out, so a source ends within one document of its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch, ordered
from bytelens.session import ship

#: Words as the mixing counts them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeat: float, scratch: Scratch) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds ``target``.

    Sources take the weights in turn by code point, null last. Targets share the total by weight; one that
    would pass ``max_repeat`` times its source stops there and the rest is shared again by weight. The level of
    the shares is found by aggregates alone, so any number of sources will do.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = ordered(sizes, order, scratch, pos="_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = scratch.save(ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(max_repeat)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        at = F.col("_w") * level >= F.col("_cap")
        capped, free = ranked.agg(F.sum(F.when(at & F.lit(level > 0), F.col("_cap")).otherwise(0.0)), F.sum(F.when(at & F.lit(level > 0), 0.0).otherwise(F.col("_w")))).first()
        new = (total - capped) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _unit(a: int, b: int, seed: int) -> float:
    """A number in (0, 1) that two ids and the seed fix."""
    x = (a * 0x9E3779B97F4A7C15 ^ (b + 0x7F4A7C15) * 0xBF58476D1CE4E5B9 ^ seed * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) + 0.5) / 2.0**64


_EPS = 1e-12


def _settle(p: list[float], *places: int) -> None:
    for k in places:
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(round(p[k]))


def _pair(keys: list[int], sizes: list[float], p: list[float], j: int, i: int, seed: int) -> int | None:
    """Move words between items j and i until one is settled; the place of the one that stays open, or None."""
    a, b = sizes[j], sizes[i]
    up = min((1 - p[j]) * a, p[i] * b)  # words that can move from i to j
    down = min(p[j] * a, (1 - p[i]) * b)
    move = up if _unit(keys[j], keys[i], seed) * (up + down) < down else -down
    p[j] += move / a
    p[i] -= move / b
    _settle(p, j, i)
    return i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None


def _against_all(keys: list[int], sizes: list[float], p: list[float], j: int, n: int, seed: int) -> None:
    """Settle item j against the open ones of the first n items together, each giving or taking in proportion."""
    pool = [i for i in range(n) if 0 < p[i] < 1]
    have = sum(p[i] * sizes[i] for i in pool)
    room = sum((1 - p[i]) * sizes[i] for i in pool)
    up, down = min((1 - p[j]) * sizes[j], have), min(p[j] * sizes[j], room)
    if up <= 0 or down <= 0:
        return
    if _unit(keys[j], -3, seed) * (up + down) < down:
        p[j] += up / sizes[j]
        for i in pool:
            p[i] -= up / have * p[i]
    else:
        p[j] -= down / sizes[j]
        for i in pool:
            p[i] += down / room * (1 - p[i])
    _settle(p, j, *pool)


def _round(keys: list[int], sizes: list[float], p: list[float], n: int, seed: int) -> int | None:
    small = n // 2 if n > 4 else 0
    open_ = None
    for i in range(small, n):
        if 0 < p[i] < 1:
            open_ = i if open_ is None else _pair(keys, sizes, p, open_, i, seed)
    if small:
        if open_ is not None:
            _against_all(keys, sizes, p, open_, small, seed)
            open_ = open_ if 0 < p[open_] < 1 else None
        rest = _round(keys, sizes, p, small, seed)
        open_ = rest if open_ is None else open_ if rest is None else _pair(keys, sizes, p, open_, rest, seed)
    return open_


def pivot(keys: list[int], sizes: list[float], p: list[float], seed: int) -> tuple[list[float], int | None]:
    """Round fractions p of items in ascending order of size, keeping sum(size * p) as it is; at most one stays open.

    Returns the new p and the place of the open item, or None. Large items meet each other first and the last
    of them the small ones together, so what stays open is small. An item of size 0 is rounded by itself.
    """
    out = list(p)
    _settle(out, *range(len(out)))
    for i, size in enumerate(sizes):
        if size <= 0 and 0 < out[i] < 1:
            out[i] = float(_unit(keys[i], -1, seed) < out[i])
    return out, _round(keys, sizes, out, len(out), seed)


def _level(seed: int, last: bool):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_key"], kind="stable")
        keys = pdf["_key"].tolist()
        p, open_ = pivot(keys, pdf["_size"].tolist(), pdf["_p"].tolist(), seed)
        if last and open_ is not None:
            p[open_] = float(_unit(keys[open_], -2, seed) < p[open_])
            open_ = None
        done = np.ones(len(p), bool)
        if open_ is not None:
            done[open_] = False
        return pdf.assign(_p=p, _done=done)

    return one


def _told_apart(rows: DataFrame, most: int = 4096) -> DataFrame:
    """rows with ``_nth``, a number that tells equal rows apart, dealt in runs of ``most`` so that no task counts out a large group."""
    n = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    up = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    runs = n.select("*", up(F.floor((F.col("_n") - 1) / most)).alias("_run")).repartition("_id", "_text", "_run")
    size = F.least(F.lit(most), F.col("_n") - F.col("_run") * most)
    return runs.select(*rows.columns, "_run", up(size - 1).alias("_at")).select(*rows.columns, (F.col("_run") * most + F.col("_at")).alias("_nth"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0, group_rows: int = 2_000, fan: int = 64, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """(id, size, source_size, target, copies) for every row of docs.

    ``copies`` is how often the mix takes the row (0 and more, ``max_repeat`` at most where that is whole).
    Null and empty texts have size 0. Rows with equal ids are told apart by their texts, equal ones by a number.
    A source of size 0 has target 0 and no copies. Extra columns are ignored; an empty table gives no rows.
    Groups of the tree are cut by a hash of id, text and number, so a source, an id or a row with a third of all rows is
    dealt out, and a rerun gives the same copies however the rows are partitioned.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    rows = scratch.save(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("_size"), F.xxhash64(text_col).alias("_text")))
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = scratch.save(source_targets(scratch.save(sizes), weights, max_repeat, scratch))
    most = max(1, rows.groupBy("source").count().agg(F.max("count")).first()[0] or 1)
    groups = max(1, math.ceil(most / group_rows))

    t = targets.select(F.col("source").alias("_s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_r"))
    r = rows.join(t, rows["source"].eqNullSafe(t["_s"])).drop("_s")
    r = _told_apart(r).withColumn("_key", F.xxhash64("_id", "_text", "_nth")).drop("_nth").withColumn("_group", F.pmod("_key", F.lit(groups)).cast("long"))
    r = r.withColumn("_whole", F.floor("_r")).withColumn("_p", F.col("_r") - F.col("_whole"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema]
    schema = ", ".join(fields) + ", _done boolean"
    parts: list[DataFrame] = []
    current = r
    while True:
        last = groups == 1
        made = scratch.save(current.groupBy("source", "_group").applyInPandas(_level(seed, last), schema))
        parts.append(made.where("_done"))
        if last:
            break
        groups = math.ceil(groups / fan)
        current = made.where("NOT _done").drop("_done").withColumn("_group", F.floor(F.col("_group") / fan))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source", "source_size", "target", (F.col("_whole") + F.round("_p")).cast("long").alias("copies"), F.col("_text").alias("text_hash"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """The documents of the mix: each row of docs as often as ``mix`` takes it, in its own columns, whatever their names.

    Rows that are equal in id and text share what the mix takes of them: that many copies in all, dealt by a hash of the row.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    copies = mix(docs, id_col=id_col, text_col=text_col, scratch=scratch, **options)
    taken = copies.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies")).where("_copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_text"))
    j = rows.join(scratch.save(taken), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    once = j.where("_rows = 1").select("_row", F.col("_copies").alias("_n"))
    # Of several equal rows each distinct one is counted, and the copies are shared out along their running counts.
    some = j.where("_rows > 1").groupBy("_id", "_hash", "_rows", "_copies", "_row").agg(F.count("*").alias("_c"))
    run = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64(F.to_json("_row")), F.to_json("_row")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_c").over(run)
    share = lambda n: F.floor(n.cast("decimal(38,0)") * F.col("_copies") / F.col("_rows")).cast("long")
    some = some.withColumn("_upto", upto).select("_row", (share(F.col("_upto")) - share(F.col("_upto") - F.col("_c"))).alias("_n"))
    both = once.union(some).where("_n > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k")).select("_row.*")
