"""Token ids in files of patched frame-of-reference blocks.

A file, all numbers little-endian:

    magic "BLPF", version u16 1, block length u16, ids u64, documents u64, blocks u64
    per document: has an id u8; then id i64; then first token's place in the file u64
    per block: start u64, counted from the first block
    per block: least id u32, width u8, exceptions u16, then the ids less the least, `width` low bits each,
        least significant bit first; then the exceptions' places u16 and their full differences u32

The width of a block is what a percentile of its differences needs; what needs more is also in the list.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch, ordered
from bytelens.session import ship

MAGIC, VERSION = b"BLPF", 1
_HEAD = struct.Struct("<4sHHQQQ")
_BLOCK = struct.Struct("<IBH")


def _widths(top: np.ndarray) -> np.ndarray:
    return np.where(top > 0, np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 1, 0)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values in rows of bytes."""
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpack_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little", count=width * n).reshape(len(data), n, width)
    out = np.zeros((len(data), n), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_blocks(ids: np.ndarray, block: int, percentile: float) -> tuple[bytes, np.ndarray]:
    """The blocks of ids, and where each starts."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    n = -(-len(ids) // block)
    full = np.full(n * block, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, block)
    least = full.min(1)
    diff = full - least[:, None]
    rank = min(block - 1, int(np.ceil(percentile / 100 * block)) - 1)
    widths = _widths(np.partition(diff, rank, axis=1)[:, rank])
    over = diff >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    parts: list[bytes] = [b""] * n
    for w in np.unique(widths).tolist():
        for a in range(0, n, 512):
            rows = a + np.flatnonzero(widths[a : a + 512] == w)
            if not len(rows):
                continue
            packed = _pack_bits(diff[rows], w) if w else np.zeros((len(rows), 0), np.uint8)
            for k, r in enumerate(rows.tolist()):
                at = np.flatnonzero(over[r])
                parts[r] = _BLOCK.pack(int(least[r]), w, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + diff[r, at].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.uint64)
    return b"".join(parts), starts


def decode_blocks(data: memoryview, starts: np.ndarray, block: int, n_ids: int) -> np.ndarray:
    n = len(starts)
    out = np.zeros((n, block), np.uint32)
    heads = [_BLOCK.unpack_from(data, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(widths).tolist():
        size = -(-w * block // 8)
        for a in range(0, n, 512):
            rows = a + np.flatnonzero(widths[a : a + 512] == w)
            if not len(rows) or not w:
                continue
            packed = np.stack([np.frombuffer(data, np.uint8, size, int(starts[r]) + _BLOCK.size) for r in rows])
            out[rows] = _unpack_bits(packed, w, block)
    for r, (least, w, m) in enumerate(heads):
        if m:
            at = int(starts[r]) + _BLOCK.size + -(-w * block // 8)
            out[r, np.frombuffer(data, "<u2", m, at)] = np.frombuffer(data, "<u4", m, at + 2 * m)
        out[r] += np.uint32(least)
    return out.reshape(-1)[:n_ids]


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, block: int = 256, percentile: float = 90.0) -> bytes:
    body, index = encode_blocks(ids, block, percentile)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, VERSION, block, len(ids), len(doc_ids), len(index)), known.tobytes(), names.tobytes(), starts.astype("<u8").tobytes(), index.astype("<u8").tobytes(), body])


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, first token of each and the end, ids)."""
    magic, version, block, n_ids, docs, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at = _HEAD.size
    known = np.frombuffer(data, np.uint8, docs, at)
    names = np.frombuffer(data, "<i8", docs, at := at + docs)
    starts = np.frombuffer(data, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u8", blocks, at := at + 8 * docs).astype(np.int64)
    ids = decode_blocks(memoryview(data)[at + 8 * blocks :], index, block, n_ids)
    return [int(x) if k else None for x, k in zip(names, known, strict=True)], np.append(starts, n_ids), ids


def _writer(folder: str, tokenizer: str, drops_space: bool, end_id: int, file_ids: int, block: int, percentile: float):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from bytelens.llm.tokens import encoder, slices
        from bytelens.llm.tidy import tidy

        files, base = fs.FileSystem.from_uri(folder)
        enc = encoder(tokenizer, drops_space=drops_space)
        shard, made = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            starts = np.cumsum([0, *sizes])[:-1]
            data = encode_file(names, starts, np.concatenate(held), block, percentile)
            # A name of its own for every try of a task: what a lost or repeated try wrote is in no manifest.
            path = f"{base}/{shard:06d}-{made:06d}-{uuid.uuid4().hex}.blpf"
            with files.open_output_stream(path) as f:
                f.write(data)
            row = {"shard": [shard], "file": [made], "path": [path], "n_docs": [len(names)], "n_ids": [int(sum(sizes))], "n_bytes": [len(data)]}
            made += 1
            names.clear(), held.clear(), sizes.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            text = batch.column("_text").cast(pa.string())
            who = batch.column("_id").to_pylist()
            size = np.maximum(1, pc.binary_length(text).to_numpy(zero_copy_only=False))
            for a, b in slices(size, min(3_000_000, 4 * file_ids)):
                ids, ends = enc.encode(text.slice(a, b - a))
                n = np.diff(ends)
                names.extend(who[a:b])
                sizes.extend((n + 1).tolist())
                held.append(np.insert(ids, ends[1:], np.uint32(end_id)))
                if sum(map(len, held)) >= file_ids:
                    yield flush()
        if names:
            yield flush()
        tidy()

    return write


def write_store(docs: DataFrame, tokenizer: str, folder: str, *, drops_space: bool, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = 4_000_000, block: int = 256, percentile: float = 90.0, scratch: Scratch | None = None) -> DataFrame:
    """Write whole texts as token files, in ascending id order (null first); returns the manifest.

    The manifest (shard, file, path, n_docs, n_ids, n_bytes, start, bytes_before) is a written table: only the files of
    tasks that ended are in it. ``start`` and ``bytes_before`` are the ids and bytes of the files before. ``folder`` is
    a URI that pyarrow opens, on executors too. Null and empty texts are the end id alone; rows of equal ids stand
    together in the order of a hash of their texts, so an id that many rows share is dealt to several tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Copies that agree in both differ in nothing that is written.
    rows = rows.withColumn("_tie", F.xxhash64("_text")).repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").drop("_tie")
    schema = "shard int, file int, path string, n_docs long, n_ids long, n_bytes long"
    made = scratch.save(rows.mapInArrow(_writer(folder, tokenizer, drops_space, end_id, file_ids, block, percentile), schema))
    return ordered(made, [F.col("shard"), F.col("file")], scratch, {"start": "n_ids", "bytes_before": "n_bytes"}).drop("pos")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with files.open_input_stream(path) as f:
                    names, ends, ids = decode_file(f.read())
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends[:-1] + start, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_store(manifest: DataFrame, folder: str, *, task_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before.

    Files are dealt by the bytes before them, about ``task_bytes`` to a task; a file is never cut.
    """
    end = manifest.agg(F.max("bytes_before")).first()[0] or 0
    part = F.floor(F.col("bytes_before") / task_bytes).cast("int")
    files = manifest.select("path", "start", part.alias("_part")).repartitionById(end // task_bytes + 1, "_part")
    return files.select("path", "start").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def qualified(spark, path: str) -> str:
    """The full URI of a folder, made where it isn't."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark._jsc.hadoopConfiguration())
    f.mkdirs(p)
    uri = f.makeQualified(p).toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)
