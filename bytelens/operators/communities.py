"""Communities of a graph of any size, and an order that keeps them together.

Vertices merge along edges that raise modularity, in rounds over a table of edges. In a round every vertex that can gain names the
neighbour it would gain most with; those of lower degree than their choice join it, unless their choice itself moves. Of
many that name one vertex, each joins while the ones before it, in a drawn order, leave it a gain; how much those weigh
is taken from its place in that order and the sum of all, so nothing is listed by vertex. Then edges are renamed and
summed. The merges are a forest; its vertices are numbered depth first by the sizes of its subtrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.scratch import Scratch, ordered


def merge_rounds(edges: DataFrame, scratch: Scratch, *, most: int = 200) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(vertices (id, degree), the merges (child, parent) of each round, what is left of edges).

    edges: (src, dst long), undirected; repeated ones weigh as often as they stand there, self loops count for nothing. Rounds end when no
    edge raises modularity; more than ``most`` raise. A round costs joins and sums of the edges that are left.
    """
    flat = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    now = scratch.save(flat)
    ends = now.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
    vertices = degree = scratch.save(ends)
    total = vertices.agg(F.sum("degree")).first()[0] or 0
    merges: list[DataFrame] = []
    for step in range(most):
        da, db = degree.select(F.col("id").alias("a"), F.col("degree").alias("x")), degree.select(F.col("id").alias("b"), F.col("degree").alias("y"))
        gain = F.lit(float(total)) * F.col("w") - F.col("x").cast("double") * F.col("y")
        rising = now.join(da, "a").join(db, "b").withColumn("gain", gain).where("gain > 0")
        # Each end of a rising edge offers itself to the other; the best offer is a vertex's choice.
        offer = lambda v, t, d, e: F.struct(F.col(v).alias("v"), F.col("gain").alias("gain"), (-F.col(t)).alias("t"), F.col("w").alias("w"), F.col(d).alias("d"), F.col(e).alias("e"))
        both = rising.select(F.explode(F.array(offer("a", "b", "x", "y"), offer("b", "a", "y", "x"))).alias("o")).select("o.*")
        choice = both.groupBy("v").agg(F.max(F.struct("gain", "t", "w", "d", "e")).alias("c")).select("v", "c.gain", (-F.col("c.t")).alias("t"), "c.w", "c.d", "c.e")
        lower = scratch.save(choice.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("v") > F.col("t")))))
        moving = lower.join(lower.select(F.col("v").alias("t")), "t", "left_anti")
        named = scratch.save(moving)
        if not named.take(1):
            break
        sums = named.groupBy("t").agg(F.sum("d").alias("s"), F.max(F.struct("gain", "v")).alias("top"))
        room = F.lit(float(total)) * F.col("w") / F.col("d") - F.col("e")  # what may join before it and leave it a gain
        drawn = (F.pmod(F.xxhash64(F.lit(step), "v"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
        joins = named.join(sums, "t").where((F.col("v") == F.col("top.v")) | (drawn * F.col("s") <= room)).select(F.col("v").alias("child"), F.col("t").alias("parent"))
        joins = scratch.save(joins)
        merges.append(joins)
        degree = scratch.save(_renamed(degree, joins, "id").groupBy("id").agg(F.sum("degree").alias("degree")))
        new = _renamed(_renamed(now, joins, "a"), joins, "b").where("a <> b")
        new = scratch.save(new.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
        scratch.drop(now, lower, named)
        now = new
    else:
        raise RuntimeError(f"merging goes on after {most} rounds")
    return vertices, merges, now


def _renamed(rows: DataFrame, joins: DataFrame, column: str) -> DataFrame:
    to = joins.select(F.col("child").alias(column), F.col("parent").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def communities(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, community, new_id): of every vertex of undirected edges (src, dst) its community, named by one of its vertices, and its
    place in an order that keeps communities, and what merged early in them, together. No edges give no rows."""
    scratch = scratch or Scratch(edges.sparkSession)
    vertices, merges, _ = merge_rounds(edges, scratch)
    size = vertices.select("id", F.lit(1).cast("long").alias("n"))
    inside: list[DataFrame] = []  # of each round: how far behind its parent a child stands
    for joins in merges:
        grown = joins.join(size.select(F.col("id").alias("child"), F.col("n").alias("own")), "child").join(size.select(F.col("id").alias("parent"), F.col("n").alias("held")), "parent")
        # Children of one parent follow each other; the sum before a parent's first child is taken off.
        at = ordered(grown, [F.col("parent"), F.col("child")], scratch, {"before": "own"})
        at = scratch.save(at)
        base = at.groupBy("parent").agg(F.min("before").alias("base"), F.sum("own").alias("more"))
        inside.append(scratch.save(at.join(base, "parent").select("child", "parent", (F.col("held") + F.col("before") - F.col("base")).alias("behind"))))
        left = size.join(joins.select(F.col("child").alias("id")), "id", "left_anti").join(base.select(F.col("parent").alias("id"), "more"), "id", "left")
        size = scratch.save(left.select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    roots = ordered(size, [F.col("id")], scratch, {"place": "n"})
    placed = scratch.save(roots.select("id", F.col("id").alias("community"), F.col("place").alias("new_id")))
    for rows in reversed(inside):
        of = placed.select(F.col("id").alias("parent"), "community", "new_id")
        own = rows.join(of, "parent").select(F.col("child").alias("id"), "community", (F.col("new_id") + F.col("behind")).alias("new_id"))
        placed = scratch.save(placed.union(own))
    return placed


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): of undirected edges (src, dst) under labels (id, community); repeated edges count each, self loops don't."""
    e = edges.where("src <> dst")
    side = lambda c: labels.select(F.col("id").alias(c), F.col("community").alias("_" + c))
    placed = e.join(side("src"), "src").join(side("dst"), "dst")
    m, within = F.count("*"), F.count_if(F.col("_src") == F.col("_dst"))
    share = placed.agg(m.alias("m"), within.alias("within"))
    degrees = placed.select(F.explode(F.array("_src", "_dst")).alias("c")).groupBy("c").agg(F.count("*").alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return share.crossJoin(degrees).select((F.col("within") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))
