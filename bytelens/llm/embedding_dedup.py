"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from vectors that stand close in sorted orders of random hyperplane codes and is refined:
at every vector its neighbours, and those whose neighbour it is, are compared with each other, and a vector takes
whom it likes better than the worst of its list. A list that is full of links is saturated: it is enlarged to the
whole component of its vector, which is compared in blocks, and only counts leave a block. Every pair that is found
at the threshold joins its components, whether a list has room for it or not. Recall is audited
against a stated query set; while it is short the graph gets more orders and more rounds.

Vectors are compared within a cell: equal label and equal length. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelens.llm.graph import connected_components
from bytelens.llm.scratch import Scratch
from bytelens.session import ship

_log = logging.getLogger(__name__)

#: Vectors of a block that is compared as one matrix.
BLOCK = 2048


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, embedding -> id, label, dim and the unit vector as bytes, null where there is none."""
    for batch in batches:
        dims, units = [], []
        for e in batch.column("embedding").to_pylist():
            unit = None
            if e and None not in e:
                v = np.array(e, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    unit = (v / np.sqrt(v @ v)).tobytes()
            dims.append(len(e) if unit else None)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["id", "label", "dim", "unit"])


def _coder(seed: int, bits: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, d)).normal(size=(d, bits))
                at = np.flatnonzero(dims == d)
                side = _matrix(batch.column("unit").take(pa.array(at)), d) @ planes[d] > 0
                out[at] = side @ (1 << np.arange(bits, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "code"])

    return code


def _neighbours(reach: int):
    """Of rows in order: each with those that follow within reach in its cell."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            a, b, s = [], [], []
            for node, cell, unit in zip(*(batch.column(c).to_pylist() for c in ("node", "cell", "unit")), strict=True):
                v = np.frombuffer(unit, np.float64)
                kept = [x for x in kept[-reach:] if x[1] == cell]
                if kept:
                    sims = np.stack([x[2] for x in kept]) @ v
                    for x, sim in zip(kept, sims.tolist(), strict=True):
                        a.append(x[0]), b.append(node), s.append(sim)
                kept.append((node, cell, v))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "sim"])

    return near


def _across(reach: int):
    """Of rows in order: each with those before it that are in other components of its cell, the last two of each of ``reach``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, {}
        for batch in batches:
            a, b, s = [], [], []
            for node, cell, unit, comp in zip(*(batch.column(c).to_pylist() for c in ("node", "cell", "unit", "comp")), strict=True):
                if cell != held:
                    held, last = cell, {}
                v = np.frombuffer(unit, np.float64)
                others = [x for c, xs in last.items() if c != comp for x in xs]
                if others:
                    a += [x[0] for x in others]
                    b += [node] * len(others)
                    s += (np.stack([x[1] for x in others]) @ v).tolist()
                last[comp] = [*last.pop(comp, [])[-1:], (node, v)]
                if len(last) > reach + 1:
                    del last[next(iter(last))]
            yield _pairs((a, b, s))

    return near


def _forest(near: np.ndarray, root: int) -> tuple[list, list]:
    """Pairs that connect what the matrix of links connects; the search begins at ``root``."""
    i, j, left = [], [], np.ones(len(near), bool)
    for start in [*range(root, len(near)), *range(root)]:
        ahead = [start] if left[start] else []
        left[start] = False
        while ahead:
            x = ahead.pop()
            new = np.flatnonzero(near[x] & left).tolist()
            left[new] = False
            i += [x] * len(new)
            j += new
            ahead += new
    return i, j


def _meet(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, block): the members of each are compared; pairs that beat a member's worst come out,
    and of the pairs at ``least`` or more those that keep the members as connected as all of them do."""
    key, rows = None, []

    def flush() -> tuple[list, list, list]:
        if len(rows) < 2:
            return [], [], []
        v = np.stack([np.frombuffer(r[1], np.float64) for r in rows])
        worst, new = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        s = v @ v.T
        i, j = np.triu_indices(len(rows), 1)
        x = s[i, j]
        good = (new[i] | new[j]) & ((x > worst[i]) | (x > worst[j]))
        i, j, x = i[good], j[good], x[good]
        # Of what a center offers a member, its best few do; the others come by way of other centers.
        names = np.array([r[0] for r in rows])
        who, other, sim = np.r_[i, j], np.r_[j, i], np.r_[x, x]
        good = sim > worst[who]
        who, other, sim = who[good], other[good], sim[good]
        order = np.lexsort((-sim, who))
        who, other, sim = who[order], other[order], sim[order]
        start = np.r_[0, np.flatnonzero(np.diff(who)) + 1] if len(who) else np.zeros(0, int)
        nth = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
        top = nth < 4
        out = names[who[top]].tolist(), names[other[top]].tolist(), sim[top].tolist()
        near = s >= least
        np.fill_diagonal(near, False)
        if near.any():
            for x, y in zip(*_forest(near, key[0] % len(rows)), strict=True):
                out[0].append(rows[x][0]), out[1].append(rows[y][0]), out[2].append(float(s[x, y]))
        return out

    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for center, block, node, unit, worst, new in zip(*(batch.column(c).to_pylist() for c in ("center", "block", "node", "unit", "worst", "new")), strict=True):
            if (center, block) != key:
                for x, y in zip(out, flush(), strict=True):
                    x.extend(y)
                key, rows = (center, block), []
            rows.append((node, unit, worst, new))
        yield _pairs(out)
    yield _pairs(flush())


def _pairs(x: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.float64())], ["a", "b", "sim"])


def _lists(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """Of each a's pairs (a, b, sim, new) the k best, numbered by n from 1, and beyond k those that are links."""
    best = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return best.withColumn("n", F.row_number().over(w)).where((F.col("n") <= k) | (F.col("sim") >= least))


def _counts(least: float):
    """Rows sorted by (comp, i, j, side): links between a block's rows and those of another, or its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def flush() -> tuple[list, list]:
            if key is None:
                return [], []
            left, right = sides
            v = np.stack([np.frombuffer(r[1], np.float64) for r in left])
            m = np.array([r[2] for r in left])
            if key[1] == key[2]:
                hit = v @ v.T >= least
                np.fill_diagonal(hit, False)
                return [r[0] for r in left], (hit @ m).tolist()
            if not right:
                return [], []
            u = np.stack([np.frombuffer(r[1], np.float64) for r in right])
            n = np.array([r[2] for r in right])
            hit = v @ u.T >= least
            return [r[0] for r in left] + [r[0] for r in right], (hit @ n).tolist() + (hit.T @ m).tolist()

        def batch_of(x: tuple[list, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], ["node", "n"])

        for batch in batches:
            out: tuple[list, list] = ([], [])
            for comp, i, j, side, node, unit, weight in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "side", "node", "unit", "weight")), strict=True):
                if (comp, i, j) != key:
                    for x, y in zip(out, flush(), strict=True):
                        x.extend(y)
                    key, sides = (comp, i, j), ([], [])
                sides[side].append((node, unit, weight))
            yield batch_of(out)
        yield batch_of(flush())

    return count


def _auditor(names: list, cells: list, units: list, comps: list, least: float):
    """For each asked class and component that has links of it: one of them (a, b), their number n, and whether it is a's own."""

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict = {}
        for i, c in enumerate(cells):
            where.setdefault(c, []).append(i)
        q = {c: np.stack([np.frombuffer(units[i], np.float64) for i in ii]) for c, ii in where.items()}
        seen: dict[tuple[int, int], list[int]] = {}  # of a task, so that it sends a row for each at most
        for batch in batches:
            cell, node, comp = (batch.column(c).to_pylist() for c in ("cell", "node", "comp"))
            for c, ii in where.items():
                at = [k for k, x in enumerate(cell) if x == c]
                if at:
                    v = np.stack([np.frombuffer(x, np.float64) for x in batch.column("unit").take(pa.array(at)).to_pylist()])
                    kinds, kind = np.unique([comp[k] for k in at], return_inverse=True)
                    hits = q[c] @ v.T >= least
                    for x in np.flatnonzero(hits.any(1)).tolist():
                        own = np.flatnonzero(hits[x])
                        own = own[[node[at[y]] != names[ii[x]] for y in own.tolist()]]
                        some, first, n = np.unique(kind[own], return_index=True, return_counts=True)
                        for k, f, m in zip(some.tolist(), first.tolist(), n.tolist(), strict=True):
                            seen.setdefault((ii[x], int(kinds[k])), [node[at[own[f]]], 0])[1] += m
        rows = [(names[i], b, n, comps[i] == k) for (i, k), (b, n) in seen.items()]
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds_)], ["a", "b", "n", "same"])

    return audit


def near_embeddings(vectors: DataFrame, *, least: float = 0.98, neighbours: int = 10, orders: int = 8, reach: int = 6, bits: int = 48, rounds: int = 3, audit: int = 256, recall: float = 0.98, tries: int = 3, seen: int = 1_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows are linked if their labels are equal and not null, their lengths too, and their cosine in double precision
    is ``least`` or more. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; nor do rows with a null id, whose component is null and which are kept. Rows that share an id are
    one for reachability. The audit compares ``audit`` classes (by hash) with all, or up to 16 times as many
    while they see fewer than ``seen`` links, and repeats the search with
    ``orders`` more while fewer than ``recall`` of their links join one component, ``tries`` times at most, and raises beyond; its links join
    in. Extra columns are ignored; no rows give none.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = scratch.save(raw.mapInArrow(_unit, "id long, label string, dim int, unit binary"))
    usable = rows.where("unit IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    # A class of equal vectors is a node of its own, whatever ids its rows have.
    classes = usable.groupBy("label", "dim", "unit").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))
    classes = classes.withColumn("cell", F.concat_ws(":", F.col("dim").cast("string"), "label"))
    units = classes.select("node", "unit")

    graph, links, roots = None, None, None
    for attempt in range(tries):
        found = None
        for t in range(orders):
            coded = classes.select("node", "cell", "dim", "unit").mapInArrow(_coder(attempt * orders + t, bits), "node long, cell string, dim int, unit binary, code long")
            line = coded.repartitionByRange("cell", "code", "node").sortWithinPartitions("cell", "code", "node")
            pairs = line.mapInArrow(_neighbours(reach), "a long, b long, sim double")
            found = pairs if found is None else found.union(pairs)
        found = found.where("a <> b").withColumn("new", F.lit(1))
        found = found.select("a", "b", "sim", "new").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new"))
        # Every pair found at the threshold is a link, also where it is beyond a full list.
        listed = scratch.save(_lists(found if graph is None else found.union(graph.select("a", "b", "sim", F.lit(0))), neighbours, least))
        graph, mine = listed.where(F.col("n") <= neighbours), [listed.where(F.col("sim") >= least).select("a", "b")]
        for _ in range(rounds):
            worst = graph.groupBy("a").agg(F.when(F.count("*") >= neighbours, F.min("sim")).otherwise(-2.0).alias("worst"))
            # A center meets its list, and in blocks of a bounded size those whose lists it is in.
            fwd = graph.select(F.col("a").alias("center"), F.col("b").alias("node"), "new")
            deg = graph.groupBy("b").agg(F.ceil(F.count("*") / (4 * neighbours)).alias("blocks"))
            back = graph.join(deg, "b").select(F.col("b").alias("center"), F.col("a").alias("node"), "new", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), "blocks")
            wide = fwd.join(deg.withColumnRenamed("b", "center"), "center", "left").select("center", "node", "new", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
            talk = wide.select("center", "block", "node", "new").union(back.select("center", "block", "node", "new")).groupBy("center", "block", "node").agg(F.max("new").alias("new"))
            talk = talk.join(units, "node").join(worst.withColumnRenamed("a", "node"), "node", "left").select("center", "block", "node", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"), (F.col("new") == 1).alias("new"))
            offers = talk.repartition("center", "block").sortWithinPartitions("center", "block", "node").mapInArrow(partial(_meet, least=least), "a long, b long, sim double")
            both = graph.select("a", "b", "sim", F.lit(0).alias("new")).union(offers.where("a <> b").select("a", "b", "sim", F.lit(1).alias("new")))
            listed = scratch.save(_lists(both, neighbours, least))
            graph = listed.where(F.col("n") <= neighbours)
            mine.append(listed.where(F.col("sim") >= least).select("a", "b"))
            if not graph.where(F.col("new") == 1).take(1):
                break
        links = scratch.save(reduce(DataFrame.union, mine if links is None else [links, *mine]).distinct())
        roots = scratch.save(connected_components(links, scratch))
        # A link between two full lists of links is in neither: such vectors stand in orders of their own and meet other components.
        full = graph.groupBy("a").agg(F.count("*").alias("c"), F.min("sim").alias("worst")).where((F.col("c") >= neighbours) & (F.col("worst") >= least))
        full = classes.join(full.select(F.col("a").alias("node")), "node").join(roots, "node", "left")
        full = scratch.save(full.select("node", "cell", "dim", "unit", F.coalesce("component", "node").alias("comp")))
        met = None
        for t in range(orders):
            coded = full.mapInArrow(_coder((1 + tries + attempt) * orders + t, bits), "node long, cell string, dim int, unit binary, comp long, code long")
            line = coded.repartitionByRange("cell", "code", "node").sortWithinPartitions("cell", "code", "node")
            pairs = line.mapInArrow(_across(reach), "a long, b long, sim double").where(F.col("sim") >= least).select("a", "b")
            met = pairs if met is None else met.union(pairs)
        met = scratch.save(met.distinct())
        if met.take(1):
            links = scratch.save(links.union(met).distinct())
            roots = scratch.save(connected_components(links, scratch))
        # The audit's queries are `audit` classes, and four times as many until they see `seen` links; at most 16 times `audit`.
        placed = classes.join(roots, "node", "left").select("node", "cell", "unit", F.coalesce("component", "node").alias("comp"))
        for size in (audit, 4 * audit, 16 * audit):
            asked = placed.orderBy(F.xxhash64("unit"), "node").limit(size).collect()
            true = scratch.save(placed.mapInArrow(_auditor(*([r[c] for r in asked] for c in ("node", "cell", "unit", "comp")), least), "a long, b long, n long, same boolean"))
            n, hit = true.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0))).first()
            if len(asked) < size or n >= seen:
                break
        if hit < n:
            links = scratch.save(links.union(true.where("NOT same").select("a", "b")).distinct())
            roots = scratch.save(connected_components(links, scratch))
        _log.info("the audit saw %d links, of which %d join one component", n, hit)
        if hit >= recall * n:
            break
    else:
        raise RuntimeError(f"recall {hit / n:.3f} is below {recall} after {tries} tries: give more orders, a longer reach or more neighbours")

    # Every list of links is enlarged to its component; the blocks of one are compared pair by pair of blocks.
    every = roots.select("node", "component").union(roots.select(F.col("component").alias("node"), "component").distinct())
    member = classes.join(every, "node").select("node", F.col("component").alias("comp"), "cell", "unit", "weight")
    size = member.groupBy("comp", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    member = member.join(size, ["comp", "cell"]).withColumn("i", F.pmod(F.xxhash64("node", "unit"), F.col("k")))
    sent = member.select("comp", "cell", "node", "unit", "weight", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    sent = sent.select(F.concat_ws("/", F.col("comp").cast("string"), "cell").alias("comp"), F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), F.when(F.col("i") <= F.col("o"), 0).otherwise(1).alias("side"), "node", "unit", "weight")
    sent = sent.select("comp", F.col("x").alias("i"), F.col("y").alias("j"), "side", "node", "unit", "weight")
    n = sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side", "node").mapInArrow(_counts(least), "node long, n long")
    n = n.groupBy("node").agg(F.sum("n").alias("n"))
    full = scratch.save(classes.join(n, "node", "left").select("label", "dim", "unit", "node", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    each = scratch.save(rows.where("id IS NOT NULL").join(full.drop("id"), ["label", "dim", "unit"], "left").select("id", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    # Rows of one id are one for reachability: their classes are joined, and rows that link with nothing follow.
    same = each.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c")).where("c > 1 AND lo IS NOT NULL").select("id", "lo", "hi")
    same = scratch.save(same)
    if same.where("lo < hi").take(1):
        more = each.join(same.where("lo < hi"), "id").where("node > lo").select("node", "lo")
        roots = scratch.save(connected_components(more.union(roots), scratch))
    named = full.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = named.join(scratch.save(named.groupBy("root").agg(F.min("id").alias("component_id"))), "root").select("node", "component_id")
    out = each.join(named, "node", "left")
    if same.take(1):
        of = named.join(same.select(F.col("lo").alias("node"), "id"), "node").select("id", F.col("component_id").alias("shared"))
        out = out.join(of, "id", "left").withColumn("component_id", F.coalesce("component_id", "shared"))
    out = out.select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    none = rows.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    both = out.union(none)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
