"""Payloads from files: whole files, fixed blocks of them, extent sidecars and graph files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def payloads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, payload) of every file."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", F.col("content").alias("payload"))


def blocks(df: DataFrame, payload: str = "payload", size: int = 4096, *, tail: bool = True) -> DataFrame:
    """df with a row for each slice of ``size`` bytes: block (from 0) and its bytes in place of the payload."""
    n = F.length(payload) / size
    count = (F.ceil(n) if tail else F.floor(n)).cast("int")
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("block")
    cut: Column = F.substring(F.col(payload), F.col("block") * size + 1, F.lit(size))
    return df.select("*", at).withColumn(payload, cut)


SIDECAR_MAGIC = b"F22EXTV1"
_SIDECAR = "extent_id string, policy string, h1 float, h2 float, h3 float, top16_coverage float, rl_fraction float, byte_entropy_skew float, payload binary"


def write_sidecar(rows: list[tuple]) -> bytes:
    """rows: (id, policy, six floats, payload)."""
    out = [SIDECAR_MAGIC, struct.pack("<I", len(rows))]
    for name, policy, *values, payload in rows:
        out += [name.encode().ljust(32, b"\0")[:32], policy.encode().ljust(16, b"\0")[:16], struct.pack("<I6f", len(payload), *values), payload]
    return b"".join(out)


def read_sidecar(raw: bytes) -> Iterator[tuple]:
    if raw[:8] != SIDECAR_MAGIC:
        raise ValueError("no extent sidecar")
    at = 12
    for _ in range(struct.unpack_from("<I", raw, 8)[0]):
        name, policy = (raw[a:b].rstrip(b"\0").decode() for a, b in ((at, at + 32), (at + 32, at + 48)))
        n, *values = struct.unpack_from("<I6f", raw, at + 48)
        at += 76
        if at + n > len(raw):
            raise ValueError("the sidecar is cut off")
        yield name, policy, *values, raw[at : at + n]
        at += n


def extents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each extent of the sidecar files under path."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 2 + [pa.float32()] * 6 + [pa.binary()]
        names = [x.split()[0] for x in _SIDECAR.split(", ")]
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                cols = list(zip(*read_sidecar(raw), strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return payloads(spark, path).select("payload").mapInArrow(parse, _SIDECAR)


def graphs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, rows, dims, metric, scalar, top, error, payload) of the graph files under path; what can't be read says why."""
    from bytelens.functions import hnsw
    from bytelens.session import ship

    ship(spark)
    names = ("path", "rows", "dims", "metric", "scalar", "top", "error", "payload")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                try:
                    g = hnsw.read(raw)
                    dims = struct.unpack_from("<Q", raw, 8 + g.vectors.size + 33)[0]
                    row = (name, len(g.keys), dims, g.metric, g.scalar, g.top, None, raw)
                except hnsw.GraphError as e:
                    row = (name, None, None, None, None, None, str(e), raw)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], list(names))

    return payloads(spark, path, glob).select("path", "payload").mapInArrow(parse, "path string, rows long, dims long, metric string, scalar string, top int, error string, payload binary")


def graph_search(queries: DataFrame, graph: bytes, *, k: int, ef: int = 64, permits: set[int] | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, rank, key, distance) from a graph file of one machine's size, which is sent to every task.

    With ``permits`` only those nodes are results; the way to them goes through all.
    """
    from bytelens.functions import hnsw

    hnsw.read(graph)  # fails here rather than in a task
    shared = queries.sparkSession.sparkContext.broadcast(graph)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = hnsw.read(shared.value)
        for batch in batches:
            rows = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                rows += [(i, r, key, d) for r, (key, d) in enumerate(hnsw.search(g, v, k, ef, permits), 1)] if v is not None else []
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["id", "rank", "key", "distance"])

    return queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(find, "id long, rank int, key long, distance double")


def graph_files(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", part: int = 16_384) -> DataFrame:
    """(dim, part, graph, starts, ids): every row in a graph file of one hash part of its length.

    A part has about ``part`` rows. Its nodes are its distinct vectors; node i stands for ids[starts[i]:starts[i + 1]],
    both little-endian 64-bit. Rows without an id, or whose vector is null, empty or holds nulls or non-finite values, are in none.
    """
    from bytelens.functions import hnsw
    from bytelens.session import ship

    ship(vectors.sparkSession)
    v = _whole(vectors, id_col, vector_col)
    parts = v.groupBy("dim").agg(F.ceil(F.count("*") / part).alias("parts"))
    rows = v.join(F.broadcast(parts), "dim").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = np.array(t.column("v").combine_chunks().flatten().to_numpy(), np.float32).reshape(t.num_rows, -1) + np.float32(0)
        nodes, at = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        ids = t.column("id").to_numpy()[order].astype("<i8")
        starts = np.r_[0, np.cumsum(np.bincount(at.ravel(), minlength=len(nodes)))].astype("<i8")
        links, entry = hnsw.build(nodes)
        graph = hnsw.write(list(range(len(nodes))), nodes, links, entry)
        return pa.table({"dim": t.column("dim")[:1], "part": t.column("part")[:1], "graph": [graph], "starts": [starts.tobytes()], "ids": [ids.tobytes()]})

    return rows.select("dim", "part", "id", "v").groupBy("dim", "part").applyInArrow(one, "dim int, part long, graph binary, starts binary, ids binary")


def graph_nearest(queries: DataFrame, files: DataFrame, *, k: int, ef: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8_192) -> DataFrame:
    """(id, rank, key, distance): of each query the k nearest found in all ``files`` of its length, ties by key.

    A file meets the queries in hash blocks of about ``block``; what leaves a search is k rows for each query and file.
    """
    from bytelens.functions import hnsw
    from bytelens.session import ship

    ship(queries.sparkSession)
    q = _whole(queries, id_col, vector_col)
    blocks = q.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    parts = files.groupBy("dim").agg(F.collect_set("part").alias("parts"))
    asked = q.join(F.broadcast(blocks), "dim").join(F.broadcast(parts), "dim")
    asked = asked.select("dim", F.explode("parts").alias("part"), F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("block"), "id", "v")
    sent = files.join(F.broadcast(blocks), "dim").select("dim", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "graph", "starts", "ids")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            f = {c: right.column(c)[0].as_py() for c in ("graph", "starts", "ids")}
            g, starts, ids = hnsw.read(f["graph"]), np.frombuffer(f["starts"], "<i8"), np.frombuffer(f["ids"], "<i8")
            x = np.array(left.column("v").combine_chunks().flatten().to_numpy(), np.float32).reshape(left.num_rows, -1)
            for i, v in zip(left.column("id").to_pylist(), x, strict=True):
                # Of a node's ids the k least are enough; the k nearest nodes hold k ids or more, if there are so many.
                near = [(d, key) for node, d in hnsw.search(g, v.tobytes(), k, ef) for key in ids[starts[node] : min(starts[node + 1], starts[node] + k)].tolist()]
                rows += [(i, key, d) for d, key in sorted(near)[:k]]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "key", "distance"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    on = ("dim", "part", "block")
    found = asked.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(find, "id long, key long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "key", "distance")


def _whole(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).withColumn("dim", F.size("v"))
    return v.where("id IS NOT NULL AND v IS NOT NULL AND dim > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))")
