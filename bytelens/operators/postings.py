"""Posting lists in compressed blocks with skip entries.

Ids are cut into ranges of SPAN, so a term that a large share of the rows has is dealt to many tasks; inside a range a term's
ids stand in blocks of PER, as gaps in Stream-VByte, each with its least and greatest id. A conjunction reads those
two first and decodes only blocks that overlap a block of every other term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from bytelens.functions.codecs import stream_vbyte, stream_vbyte_decode, undelta

SPAN, PER = 65_536, 128
_BLOCKS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int32()), ("control", pa.binary()), ("data", pa.binary())]))


def _encode(lists: pa.Array) -> pa.Array:
    out = []
    for ids in lists.to_pylist():
        v = np.sort(np.array(ids, np.int64))
        rows = []
        for i in range(0, len(v), PER):
            own = v[i : i + PER]
            control, data = stream_vbyte(np.diff(own, prepend=own[:1]).astype(np.uint32))
            rows.append({"lo": int(own[0]), "hi": int(own[-1]), "n": len(own), "control": control, "data": data})
        out.append(rows)
    return pa.array(out, _BLOCKS)


def _decode(lo: pa.Array, n: pa.Array, control: pa.Array, data: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (lo, n, control, data)), strict=True)
    ids = [a + undelta(stream_vbyte_decode(c, d, k).astype(np.int64)) for a, k, c, d in rows]
    at = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))


def posting_blocks(index: DataFrame) -> DataFrame:
    """(term, span, lo, hi, n, control, data) of an index (term, id), ids whole numbers; repeated and null rows count once and not at all."""
    ids = index.where("term IS NOT NULL AND id IS NOT NULL").select("term", F.col("id").cast("long").alias("id")).distinct()
    lists = ids.groupBy("term", F.floor(F.col("id") / SPAN).alias("span")).agg(F.collect_list("id").alias("ids"))  # SPAN at most
    kind = "array<struct<lo:bigint,hi:bigint,n:int,control:binary,data:binary>>"
    return lists.select("term", "span", F.inline(arrow_udf(_encode, kind)("ids")))


def ids_of(blocks: DataFrame) -> DataFrame:
    """(term, id) of blocks, decoded."""
    return blocks.select("term", F.explode(arrow_udf(_decode, "array<bigint>")("lo", "n", "control", "data")).alias("id"))


def blocks_that_meet(blocks: DataFrame, terms: list) -> DataFrame:
    """The blocks of the terms that overlap a block of every other of them. Skip entries alone are compared; a span of one
    term has SPAN / PER of them at most."""
    wanted = list(dict.fromkeys(terms))
    skips = blocks.select("term", "span", "lo", "hi")
    out = None
    for t in wanted:
        mine = blocks.where(_is(t))
        for u in wanted:
            if u != t:
                other = skips.where(_is(u)).select(F.col("span").alias("_s"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
                mine = mine.join(other, (F.col("span") == F.col("_s")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")), "left_semi")
        out = mine if out is None else out.union(mine)
    return out


def _is(term) -> Column:
    return F.col("term") == F.lit(term)


def block_all_of(blocks: DataFrame, terms: list) -> DataFrame:
    """Ids that stand under every term; no terms have none."""
    if not terms:
        return blocks.select(F.lit(0).cast("long").alias("id")).limit(0)
    return ids_of(blocks_that_meet(blocks, terms)).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(terms))).select("id")


def block_but_not(ids: DataFrame, blocks: DataFrame, terms: list) -> DataFrame:
    """ids without those that stand under any of the terms; blocks of spans without ids aren't decoded."""
    spans = ids.select(F.floor(F.col("id") / SPAN).alias("span")).distinct()
    found = ids_of(blocks.where(F.col("term").isin(list(set(terms)))).join(spans, "span", "left_semi")).select("id").distinct()
    return ids.join(found, "id", "left_anti")
