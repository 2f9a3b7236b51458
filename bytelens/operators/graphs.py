"""Tables of edges and permutations: neighbours, checks, gains and reordering, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.scratch import Scratch, ordered


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, degree, strength, neighbours) of undirected edges (src, dst, weight), each given once."""
    n = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))
    return n.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.array_sort(F.collect_list("other")).alias("neighbours"))


def bin_chain(rows: DataFrame) -> DataFrame:
    """rows: (id long, bins array). (src, dst, weight): ids that follow each other in a bin, in id order, and in how many bins.

    Rows are numbered along (bin, id) and each meets the next one, so a bin of any size is dealt out.
    """
    from bytelens.operators.content import numbered

    flat = rows.select("id", F.explode(F.array_distinct("bins")).alias("bin"))
    at = numbered(flat, ["bin", "id"], "pos")
    after = at.select((F.col("pos") - 1).alias("pos"), F.col("bin").alias("then"), F.col("id").alias("dst"))
    pairs = at.join(after, "pos").where((F.col("bin") == F.col("then")) & (F.col("id") != F.col("dst")))
    return pairs.groupBy(F.col("id").alias("src"), "dst").agg(F.count("*").alias("weight"))


def check_csr(rows: DataFrame) -> DataFrame:
    """rows: (id, start, neighbours) of a compressed graph over ids from 0. What is wrong: (id, problem); no rows if nothing.

    Each row must begin where the one before ends, its neighbours must rise strictly, and each must be an id.
    """
    ids = rows.select(F.col("id").alias("other"))
    n = F.size("neighbours")
    ends = rows.select((F.col("id") + 1).alias("id"), (F.col("start") + n).alias("end"))
    gaps = rows.join(ends, "id", "left").where(F.coalesce("end", F.lit(0)) != F.col("start")).select("id", F.lit("start").alias("problem"))
    falls = rows.where(F.exists(F.transform("neighbours", lambda x, i: (i > 0) & (x <= F.get("neighbours", i - 1))), lambda x: F.coalesce(x, F.lit(False)))).select("id", F.lit("order").alias("problem"))
    flat = rows.select("id", F.explode("neighbours").alias("other"))
    strange = flat.join(ids, "other", "left_anti").select("id", F.lit("neighbour").alias("problem")).distinct()
    return gaps.union(falls).union(strange)


def modularity_gains(edges: DataFrame) -> DataFrame:
    """(src, dst, gain): what joining the two ends of each edge would add to modularity, scaled to whole numbers."""
    s = edges.select(F.col("src").alias("id"), "weight").union(edges.select("dst", "weight")).groupBy("id").agg(F.sum("weight").alias("d"))
    total = s.agg(F.sum("d")).first()[0] or 0
    a, b = s.select(F.col("id").alias("src"), F.col("d").alias("x")), s.select(F.col("id").alias("dst"), F.col("d").alias("y"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("weight") * F.lit(total) - F.col("x") * F.col("y")).alias("gain"))


def check_permutation(order: DataFrame) -> None:
    """Raise unless (id, new_id) has each id once and new ids from 0 without gaps."""
    n, ids, places, low, high = order.agg(F.count("*"), F.countDistinct("id"), F.countDistinct("new_id"), F.min("new_id"), F.max("new_id")).first()
    if n and not (n == ids == places and low == 0 and high == n - 1):
        raise ValueError("not a permutation")


def invert(order: DataFrame) -> DataFrame:
    """(id, new_id) of the way back, for ids from 0."""
    return order.select(F.col("new_id").alias("id"), F.col("id").alias("new_id"))


def permute(rows: DataFrame, order: DataFrame) -> DataFrame:
    """rows, by ``id``, with their place ``new_id`` in a checked permutation of all of them."""
    check_permutation(order)
    return rows.join(order, "id")


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: two long columns (u, v). Returns (node, component): every node that has an edge to another
    and is not itself the smallest of its component, with that smallest id. Self loops and null ends are
    ignored. Each round sends every node's neighbours to the least of them; minima are pre-aggregated, so
    a hub with a third of all edges is one partial aggregate and a join that adaptive execution can split.
    """
    u, v = edges.columns[:2]
    now = scratch.save(
        edges.where(f"`{u}` <> `{v}`").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large, now)
        now, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _walk(both: DataFrame, start: DataFrame, total: int, scratch: Scratch, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], DataFrame] = lambda new: new) -> list[DataFrame]:
    """The written levels of a search through edges (u, v) from all rows of ``start`` (id, ...) at once, ``total`` vertices in all.

    step(edges that leave the level before, with its rows) -> rows (id, ...), once each. What a level meets stands in the two
    before it or is new; done(new rows) -> the rows of the level.
    """
    found = [scratch.save(start)]
    seen = found[0].count()
    while seen < total:
        new = step(both.join(found[-1].withColumnRenamed("id", "u"), "u"))
        for before in found[-2:]:
            new = new.join(before.select("id"), "id", "left_anti")
        new = scratch.save(done(new))
        count = new.count()
        if not count:
            break
        seen += count
        found.append(new)
    return found


def rcm_levels(edges: DataFrame, scratch: Scratch, tries: int = 8) -> DataFrame:
    """(id, new_id): the reverse Cuthill-McKee order of ``functions.orders.rcm``, the same one, level by level as joins.

    A vertex stands behind the first vertex of the level before that it is a neighbour of, by degree and id among those, so
    a level is sorted at once, and all components go on together. A level costs joins with all edges: a graph of many
    edges that is also many thousand levels deep takes that many rounds.
    """
    flat = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = scratch.save(flat.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")))).otherwise(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).alias("e")).select("e.*"))
    label = connected_components(both.where("u > v"), scratch)
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    vertices = scratch.save(degree.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "degree", F.coalesce("component", "id").alias("comp")))
    least = F.min(F.struct("degree", "id"))
    seeds = scratch.save(vertices.groupBy("comp").agg(least.alias("s"), F.count("*").alias("n")).select("comp", "s.degree", "s.id", "n"))

    def depths(roots: DataFrame) -> DataFrame:
        """(id, comp, level) of the components of roots (comp, id)."""
        total = seeds.join(roots.select("comp"), "comp", "left_semi").agg(F.sum("n")).first()[0] or 0
        step = lambda met: met.groupBy(F.col("v").alias("id")).agg(F.min("comp").alias("comp"))
        rows = None
        for k, level in enumerate(_walk(both, roots.select("id", "comp"), total, scratch, step)):
            one = level.select("id", "comp", F.lit(k).alias("level"))
            rows = one if rows is None else rows.union(one)
        return scratch.save(rows)

    # Towards an end of each component, from its vertex of least degree, while that makes the search deeper.
    root = seeds.select("comp", "id")
    open_ = root
    level = depths(open_)
    for _ in range(tries):
        deep = level.groupBy("comp").agg(F.max("level").alias("deep"))
        at = level.join(deep, "comp").join(open_.select(F.col("comp"), F.col("id").alias("root")), "comp").join(vertices.select("id", "degree"), "id")
        far = at.where("level = deep OR id = root").groupBy("comp", "root", "deep").agg(least.alias("f"))
        far = scratch.save(far.where("f.id <> root").select("comp", "f.id", "deep"))
        if not far.take(1):
            break
        other = depths(far.select("comp", "id"))
        deeper = other.groupBy("comp").agg(F.max("level").alias("now")).join(far, "comp").where("now > deep").select("comp", "id")
        open_ = scratch.save(deeper)
        if not open_.take(1):
            break
        root = scratch.save(root.join(open_.select("comp"), "comp", "left_anti").union(open_))
        level = other.join(open_.select("comp"), "comp", "left_semi")
    first = ordered(seeds, [F.col("degree"), F.col("id")], scratch).select("comp", F.col("pos").alias("part"))
    start = root.join(first, "comp").select("id", "part", F.col("part").alias("pos"))

    def numbered(new: DataFrame) -> DataFrame:
        new = new.join(vertices.select("id", "degree"), "id").withColumnRenamed("pos", "behind")
        return ordered(new, [F.col("behind"), F.col("degree"), F.col("id")], scratch).select("id", "part", "pos")

    step = lambda met: met.groupBy(F.col("v").alias("id")).agg(F.min("part").alias("part"), F.min("pos").alias("pos"))
    n, rows = vertices.count(), None
    for k, one in enumerate(_walk(both, start, n, scratch, step, numbered)):
        one = one.select("id", "part", F.lit(k).alias("level"), F.col("pos").alias("in_level"))
        rows = one if rows is None else rows.union(one)
    return ordered(rows, [F.col("part"), F.col("level"), F.col("in_level")], scratch).select("id", (F.lit(n - 1) - F.col("pos")).alias("new_id"))
