"""Unions of many sets in containers, by group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.session import ship


def _within(by: list[str], most: int, sorted_: bool = False):
    """Merged sets of each group that a task holds; with ``sorted_`` rows one for each group, else one or more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.functions.containers import union

        held: dict[tuple, bytes] = {}
        for batch in batches:
            groups: dict[tuple, list[bytes]] = {}
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in (*by, "_set")), strict=True):
                groups.setdefault(tuple(key), []).append(raw)
            for key, sets in groups.items():
                held[key] = union([held[key], *sets] if key in held else sets)
            if len(held) > most:
                open_ = {key: held.pop(key)} if sorted_ else {}  # the last group may go on
                yield rows(held, batch.schema)
                held = open_
            schema = batch.schema
        if held:
            yield rows(held, schema)

    def rows(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], schema.field(c).type) for i, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(list(held.values()), pa.binary())], [*by, "_set"])

    return merge


def union_sets(df: DataFrame, by: list[str], column: str, *, salts: int = 16, most: int = 10_000) -> DataFrame:
    """(by, column): the union of each group's sets (see ``functions.containers``); null sets count for nothing.

    Each task merges what it holds of a group before anything is shuffled, and a group is dealt to ``salts`` tasks before
    they meet, so a group of a third of all rows is a few sets by then. A set of 32-bit numbers has half a gigabyte at most.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_set"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    merged = rows.mapInArrow(_within(by, most), kind)
    spread = merged.withColumn("_salt", F.pmod(F.xxhash64("_set"), F.lit(salts))).repartition(*by, "_salt").drop("_salt").mapInArrow(_within(by, most), kind)
    return spread.repartition(*by).sortWithinPartitions(*by).mapInArrow(_within(by, most, True), kind).withColumnRenamed("_set", column)
