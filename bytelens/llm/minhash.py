"""Near-duplicate documents by b-bit MinHash.

Each document is reduced to the minima of many hash functions over its word shingles. Runs of whole minima are
the keys of bands; documents that share a key are candidates. Of the minima only the lowest b bits are kept,
packed in planes of words, and bit counts give a similarity, corrected for chance, that drops candidates far
from the threshold. What is left is decided on the full shingle sets.

Equal sets are one class from the start. In a band's bucket each class is compared with the bucket's lead first, so
a bucket of any size costs as many comparisons as it has members. What shares any bucket with a lead is its star. In
stars that still hold several components, blocks of members meet blocks: first their packed signatures, which
tell who has a candidate in another component at all, then the full sets of those who have. Blocks are compared as
matrices inside a task and only links that join components come out, so no table grows with the pairs of a star. No
link between different sets is lost to that: two members already in one component need no link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.llm.blocks import apart, block_pairs, confirm, sized, split_stars, stars
from bytelens.llm.graph import connected_components
from bytelens.llm.scratch import Scratch
from bytelens.llm.tidy import small_batches
from bytelens.session import ship


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    from bytelens.llm.words import mix

    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * a[None] + b[None]).min(0), out=out)
    return out


def _signer(size: int, bands: int, rows: int, bits: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.tidy import tidy
        from bytelens.llm.words import NOT_SPACE, mix, shingles, words

        n = bands * rows
        a, b = _seeds(n)
        planes = -(-n // 64)
        for batch in batches:
            ids, key = batch.column("doc_id"), batch.column("text_key")
            for w in words(batch.column("_text"), NOT_SPACE):
                count, digest, keys, packed = [], [], [], []
                for k in range(w.last - w.first):
                    s = shingles(w, k, size)
                    count.append(len(s))
                    if not len(s):
                        digest.append(None), keys.append(None), packed.append(None)
                        continue
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    m = _minima(s, a, b)
                    h = np.arange(1, bands + 1, dtype=np.uint64)
                    for j in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m.reshape(bands, rows)[:, j])
                    keys.append(h.view(np.int64))
                    low = np.zeros((bits, planes * 64), np.uint8)
                    for j in range(bits):
                        low[j, :n] = (m >> np.uint32(j)) & 1
                    packed.append(np.packbits(low, axis=1, bitorder="little").reshape(-1).view("<i8"))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, w.last - w.first), key.slice(w.first, w.last - w.first), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "set_hash", "keys", "planes"],
                )
        tidy()

    return sign


def sign(docs: DataFrame, *, size: int = 5, bands: int = 64, rows: int = 8, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash, keys, planes) of every whole text; the last three null without words."""
    ship(docs.sparkSession)
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows_.mapInArrow(_signer(size, bands, rows, bits), "doc_id long, text_key long, n_shingles long, set_hash binary, keys array<long>, planes array<long>")


def estimate(a: Column, b: Column, n: int, bits: int) -> Column:
    """Similarity of two packed signatures of n minima, corrected for equal bits by chance."""
    w = -(-n // 64)
    differ = sum((F.bit_count(_any_differs(a, b, i, w, bits)) for i in range(1, w)), F.bit_count(_any_differs(a, b, 0, w, bits)))
    chance = 2.0**-bits
    return ((1 - differ / F.lit(float(n))) - chance) / (1 - chance)


def _any_differs(a: Column, b: Column, word: int, words_: int, bits: int) -> Column:
    out = a[word].bitwiseXOR(b[word])
    for j in range(1, bits):
        out = out.bitwiseOR(a[word + j * words_].bitwiseXOR(b[word + j * words_]))
    return out


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.tidy import tidy
        from bytelens.llm.words import NOT_SPACE, shingles, words

        for batch in batches:
            names, want = batch.column("node").to_pylist(), batch.column("set_hash").to_pylist()
            for w in words(batch.column("_text"), NOT_SPACE):
                node, out = [], []
                for k in range(w.last - w.first):
                    s = shingles(w, k, size).tobytes()
                    if hashlib.blake2b(s, digest_size=16).digest() == want[w.first + k]:  # else another text with this key
                        node.append(names[w.first + k]), out.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])
        tidy()

    return sets


def _alike(percent: int):
    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return alike


def _candidates(n: int, bits: int, cut: float, percent: int):
    """Members of either block whose signature is near one of another component in the other block."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        words_, chance = -(-n // 64), 2.0**-bits
        own = [np.asarray(t["planes"].combine_chunks().flatten()).view(np.uint64).reshape(t.num_rows, bits, words_) for t in (a, b)]
        size = [t["n_shingles"].to_numpy() for t in (a, b)]
        comp = [t["comp"].to_numpy() for t in (a, b)]
        hit = [np.zeros(t.num_rows, bool) for t in (a, b)]
        for i in range(0, a.num_rows, 256):
            at = slice(i, i + 256)
            differ = np.zeros((len(own[0][at]), b.num_rows), np.int32)
            for w in range(words_):
                x = own[0][at, None, 0, w] ^ own[1][None, :, 0, w]
                for j in range(1, bits):
                    x |= own[0][at, None, j, w] ^ own[1][None, :, j, w]
                differ += np.bitwise_count(x)
            small, large = np.minimum(size[0][at, None], size[1]), np.maximum(size[0][at, None], size[1])
            near = (((1 - differ / n) - chance) / (1 - chance) >= cut) & (100 * small >= percent * large) & (comp[0][at, None] != comp[1])
            hit[0][at] = near.any(1)
            hit[1] |= near.any(0)
        return pa.concat_tables([t.select(["grp", "node"]).filter(pa.array(h)) for t, h in zip((a, b), hit, strict=True)])

    return kernel


def _common(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """How many elements each set of a has in common with each of b, as products of 0/1 matrices."""
    flat = [np.concatenate(x) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)))
    if len(both):
        at = [np.searchsorted(both, x) for x in flat]
        known = [both[np.minimum(p, len(both) - 1)] == x for p, x in zip(at, flat, strict=True)]
        entries = [(r[k], p[k]) for r, p, k in zip(row, at, known, strict=True)]
        entries = [(r[o], p[o]) for r, p in entries for o in [np.argsort(p, kind="stable")]]
        for c in range(0, len(both), chunk):
            dense = []
            for (r, p), x in zip(entries, (a, b), strict=True):
                lo, hi = np.searchsorted(p, (c, c + chunk))
                m = np.zeros((len(x), min(chunk, len(both) - c)), np.float32)
                m[r[lo:hi], p[lo:hi] - c] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
    return out


def _links(percent: int):
    """Links between blocks that join components: one at most for each pair of components."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        sets = [[np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()] for t in (a, b)]
        comp = [t["comp"].to_numpy() for t in (a, b)]
        node = [t["node"].to_numpy() for t in (a, b)]
        size = [np.array([len(x) for x in s], float) for s in sets]
        both = _common(*sets)
        i, j = np.nonzero((100 * both >= percent * (size[0][:, None] + size[1] - both)) & (comp[0][:, None] != comp[1]))
        pair = np.stack([np.minimum(comp[0][i], comp[1][j]), np.maximum(comp[0][i], comp[1][j])], 1)
        _, first = np.unique(pair, axis=0, return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for k in first.tolist():
            x, y = find(int(pair[k, 0])), find(int(pair[k, 1]))
            if x != y:
                root[y] = x
                out.append(k)
        return pa.table({"a": pa.array(node[0][i[out]], pa.int64()), "b": pa.array(node[1][j[out]], pa.int64())})

    return kernel


#: A block of signatures has about so many rows; one of full sets so many bytes.
BLOCK_ROWS, SET_BYTES = 2048, 8_000_000


def full_sets(docs: DataFrame, names: DataFrame, *, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents in names (doc_id, text_key, node, set_hash), from their whole texts.

    Rows are named by id and text, so rows that share an id meet their own name alone.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("_text"))
    return text.join(sized(names), ["doc_id", "text_key"]).mapInArrow(_sets(size), "node long, shingles binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, bits: int = 2, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if their sets of ``size``-word shingles (words split at ASCII white space, A-Z lower-cased)
    have at least ``percent`` hundredths of their union in common; fewer words are one shingle, no words none
    and no link. A pair at the threshold is missed by all bands with a probability of (1 - t^rows)^bands, 8e-6
    by default. Rows that share an id are one document for reachability; a null id links with nothing: its
    component is null and it is kept. Null text is empty; very long texts count whole; extra columns are ignored, whatever
    their names; no rows give none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    n = bands * rows
    with small_batches(spark):
        signed = scratch.save(sign(docs, size=size, bands=bands, rows=rows, bits=bits, id_col=id_col, text_col=text_col))
    # A class of equal sets is a node of its own, whatever ids its rows have; (doc_id, text_key) names one of its rows.
    classes = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    classes = scratch.save(classes.select("set_hash", "x.doc_id", "x.text_key", F.monotonically_increasing_id().alias("node")))
    sig = signed.join(classes, ["set_hash", "doc_id", "text_key"]).dropDuplicates(["node"])
    sig = scratch.save(sig.select("node", "doc_id", "text_key", "n_shingles", "set_hash", "keys", "planes"))

    met = stars(sig.select("node", F.explode("keys").alias("key")), scratch)
    # Six deviations of the estimate at the threshold, of n bits that agree with a chance of about 0.85.
    sigma = 6 * math.sqrt(0.16 / n) / (1 - 2.0**-bits)
    cut = percent / 100 - sigma

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with est; far ones, and those whose sizes alone rule them out, are marked as not near."""
        a = sig.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("planes").alias("pa"))
        b = sig.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("planes").alias("pb"))
        est = estimate(F.col("pa"), F.col("pb"), n, bits)
        j = pairs.join(a, "a").join(b, "b").withColumn("est", est)
        return j.select("a", "b", "est", ((F.col("est") >= cut) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).alias("near"))

    names = sig.select("doc_id", "text_key", "node", "set_hash")
    near = scratch.save(estimated(met).where("near").select("a", "b", "est"))
    nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    with small_batches(spark):
        sets = scratch.save(full_sets(docs, scratch.save(names.join(nodes, "node")), size=size, id_col=id_col, text_col=text_col))
    scratch.release()

    label = None  # (node, component)
    label_schema = "node long, component long"

    def merged(pairs: DataFrame, sets: DataFrame) -> None:
        """Confirm pairs and bring the components up to date."""
        nonlocal label
        new = scratch.save(confirm(pairs, sets.withColumnRenamed("shingles", "held"), _alike(percent), scratch))
        if label is None or new.take(1):
            edges = new if label is None else new.union(label)
            label = scratch.save(connected_components(edges, scratch))
        scratch.release()

    if near.take(1):
        # Each member with the lead that it is most like; then for two components their likest pair; then what is left.
        best = near.groupBy("b").agg(F.max(F.struct("est", (-F.col("a")).alias("m"))).alias("x"))
        merged(best.select((-F.col("x.m")).alias("a"), "b"), sets)
        two = apart(near, label).groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("est", "a", "b")).alias("p"))
        two = scratch.save(two.select("p.a", "p.b"))
        if two.take(1):
            merged(two, sets)
            merged(scratch.save(apart(near, label).select("a", "b")), sets)
    else:
        label = spark.createDataFrame([], label_schema)

    # Members of one star that are still apart: signatures first, then the full sets of whoever has a candidate.
    star = scratch.save(split_stars(met, label, scratch))
    if star.take(1):
        signed_star = star.join(sig.select("node", "n_shingles", "planes"), "node").withColumn("weight", F.lit(1))
        found = block_pairs(signed_star, _candidates(n, bits, cut, percent), ("grp", "node"), scratch, block=BLOCK_ROWS)
        star = scratch.save(star.join(found.distinct(), ["grp", "node"]))
        scratch.release()
        nodes = star.select("node").distinct()
        sets = full_sets(docs, scratch.save(names.join(nodes, "node")), size=size, id_col=id_col, text_col=text_col)
        whole = star.join(sets, "node").withColumn("weight", F.length("shingles") + SET_BYTES // BLOCK_ROWS)
        links = scratch.save(block_pairs(whole, _links(percent), ("a", "b"), scratch, block=SET_BYTES))
        if links.take(1):
            label = scratch.save(connected_components(links.union(label), scratch))
        scratch.release()

    placed = scratch.save(signed.select("doc_id", "n_shingles", "set_hash").join(classes.select("set_hash", "node"), "set_hash", "left").drop("set_hash"))
    # Rows of one id are one document: their classes are joined, and rows without words follow.
    same = placed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c")).where("c > 1")
    same = scratch.save(same.where("lo IS NOT NULL").select("doc_id", "lo", "hi"))
    if same.where("lo < hi").take(1):
        more = placed.join(same.where("lo < hi"), "doc_id").where("node > lo").select("node", "lo")
        label = scratch.save(connected_components(more.union(label), scratch))
    named = classes.select("node", "doc_id").join(label, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = scratch.save(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = placed.join(named.join(least, "root").select("node", "component_id"), "node", "left")
    if same.take(1):
        of = named.join(least, "root").join(same.select(F.col("lo").alias("node"), F.col("doc_id").alias("id")), "node").select(F.col("id").alias("doc_id"), F.col("component_id").alias("shared"))
        out = out.join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "shared"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
