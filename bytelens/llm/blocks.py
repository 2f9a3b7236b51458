"""Comparing the members of groups with each other in bounded blocks.

Counts and names of groups are written before they are joined to the groups' rows: a join that deals both sides anew is
one that adaptive execution can split where a group has a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch
from bytelens.session import ship


def sized(names: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of names as the side of a join that goes to every task if it has ``most`` rows at most, else is shuffled."""
    return F.broadcast(names) if names.count() <= most else names.hint("shuffle_hash")


def stars(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """keyed: (node, key), once each. (a, b) once: the lead of any bucket that holds node b, and b.

    The lead of a bucket is its member with most company in all of its buckets: for a group of copies that is the same
    one in nearly all bands, so a member meets a few leads, however many keys it shares.
    """
    counts = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    # Spark sizes keyed as the nodes it was exploded from and would send it to every task.
    shared = scratch.save(keyed.join(sized(counts, 100_000), "key"))
    company = shared.groupBy("node").agg(F.sum("c").alias("s"))
    lead = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("s", (-F.col("node")).alias("m"))).alias("x"))
    met = shared.join(scratch.save(lead.select("key", (-F.col("x.m")).alias("a"))), "key").where("node <> a")
    out = scratch.save(met.select("a", F.col("node").alias("b")).distinct())
    scratch.drop(shared)
    scratch.release()
    return out


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that label (node, component) doesn't have in one component, with both components ca, cb."""
    ca = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    j = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return j.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb")


def _confirmer(alike: Callable):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None
        for batch in batches:
            a, b = [], []
            for grp, salt, is_lead, node, held in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "lead", "node", "held")), strict=True):
                if is_lead:
                    key, lead = (grp, salt), held
                elif key == (grp, salt) and alike(lead, held):
                    a.append(grp), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def confirm(pairs: DataFrame, held: DataFrame, alike: Callable, scratch: Scratch, share: int = 512) -> DataFrame:
    """The pairs (a, b) whose two ``held`` (node, held) are alike.

    What many pairs share as ``a`` goes to a task for each ``share`` of them; the others stream past it, one
    at a time, so neither memory nor a task grows with a group.
    """
    n = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("n")))
    members = pairs.join(n, "a").join(held.withColumnRenamed("node", "b"), "b")
    members = members.select(F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), F.col("n").cast("long")).cast("int").alias("salt"), F.lit(False).alias("lead"), F.col("b").alias("node"), "held")
    leads = n.join(held.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(True).alias("lead"), F.col("a").alias("node"), "held")
    there = members.union(leads).repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.col("lead").desc())
    return there.mapInArrow(_confirmer(alike), "a long, b long")


def split_stars(met: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, node, comp) of the stars of leads ``a`` whose members are still in several components."""
    star = met.select(F.col("a").alias("grp"), F.col("b").alias("node")).join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    star = scratch.save(star)
    split = star.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp")
    return star.join(scratch.save(split), "grp")


def block_pairs(members: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], columns: tuple[str, ...], scratch: Scratch, *, block: int) -> DataFrame:
    """What ``kernel`` makes of every two blocks of members of one group that can be in different components.

    members: (grp, node, comp long, weight, ...). The largest component of a group is never compared with itself; all
    others are the rest. Both are cut into blocks of about ``block`` in weight by a hash of the node, so a task holds
    two blocks, however large the group. Each block of the rest meets each of the largest and of the rest, itself
    included. kernel gets two blocks that have rows (the same one twice for itself), must pass over pairs of one component, and
    returns long ``columns``. Groups of one component give nothing.
    """
    ship(members.sparkSession)
    per = members.groupBy("grp", "comp").agg(F.sum("weight").alias("w"))
    top = per.groupBy("grp").agg(F.max(F.struct("w", "comp")).alias("t"), F.sum("w").alias("w"), F.count("*").alias("c")).where("c > 1")
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / block)).cast("int")
    sizes = scratch.save(top.select("grp", F.col("t.comp").alias("_top"), blocks(F.col("t.w")).alias("_nt"), blocks(F.col("w") - F.col("t.w")).alias("_nr")))
    m = members.join(sizes, "grp").withColumn("_rest", F.col("comp") != F.col("_top"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("_rest"), F.col("_nr")).otherwise(F.col("_nt"))).cast("int")
    up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Blocks of the rest count from 0 up, those of the largest component from -1 down.
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    met = F.when(F.col("_rest"), F.concat(F.transform(up("_nt"), lambda k: pair(F.col("_own"), -1 - k)), F.transform(up("_nr"), lambda k: pair(F.greatest("_own", k), F.least("_own", k)))))
    met = met.otherwise(F.transform(up("_nr"), lambda k: pair(k, -1 - F.col("_own"))))
    dealt = m.withColumn("_own", own).withColumn("_met", F.explode(met)).withColumn("_own", F.when(F.col("_rest"), F.col("_own")).otherwise(-1 - F.col("_own")))
    dealt = dealt.select(*members.columns, F.col("_met.i").alias("_i"), F.col("_met.j").alias("_j"), "_own")

    def meet(table: pa.Table) -> pa.Table:
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        own = table["_own"].to_numpy()
        a, b = table.filter(pa.array(own == i)), table.filter(pa.array(own == j))
        return kernel(a, b) if len(a) and len(b) else pa.table({c: pa.array([], pa.int64()) for c in columns})

    # Else a partitioning by the group alone would do, and all blocks of a large one would meet in one task.
    return dealt.repartition("grp", "_i", "_j").groupBy("grp", "_i", "_j").applyInArrow(meet, ", ".join(f"{c} long" for c in columns))
