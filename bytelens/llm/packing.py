"""Best-fit packing of documents into training sequences under several capacities at once.

A piece takes tokens, one of the document places and attention cost (its length squared). Pieces are taken by
falling length; each goes to the open sequence that can hold it in every capacity and scores best, by the norm of
what would be left or by the dot product of piece and room. Groups are packed apart; the sequences that a group
left worst filled are opened again and packed with those of other groups, level by level. A group opens only so many that
those of all groups that meet are one group's pieces again, so no group grows, whatever the lengths are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch
from bytelens.llm.tidy import small_batches
from bytelens.session import ship


def best_fit(lengths: np.ndarray, *, tokens: int, documents: int, attention: float, weights: tuple[float, float, float], score: str) -> np.ndarray:
    """The bin of each piece. lengths must fall and be at most ``tokens``."""
    n = len(lengths)
    cap = np.array([tokens, documents, attention], float)
    w = np.array(weights, float) / cap**2
    room = np.empty((3, n))
    name = np.empty(n, np.int64)
    out = np.empty(n, np.int64)
    open_, made = 0, 0
    least = int(lengths[-1]) if n else 0
    for i, x in enumerate(lengths.tolist()):
        item = np.array([x, 1.0, float(x) * x])
        r = room[:, :open_]
        fits = np.flatnonzero((r[0] >= x) & (r[1] >= 1) & (r[2] >= item[2]))
        if len(fits):
            r = r[:, fits]
            if score == "dot":
                k = int(fits[np.argmax((w * item) @ r)])
            else:
                k = int(fits[np.argmin(w @ (r - item[:, None]) ** 2)])
        else:
            k, name[open_], room[:, open_] = open_, made, cap
            open_, made = open_ + 1, made + 1
        room[:, k] -= item
        out[i] = name[k]
        if room[0, k] < least or room[1, k] < 1 or room[2, k] < least * least:  # closed: nothing that comes fits
            open_ -= 1
            room[:, k], name[k] = room[:, open_], name[open_]
    return out


def _closed(fill: np.ndarray, count: np.ndarray, *, full: float, most: int) -> np.ndarray:
    """Which sequences are done: those filled to ``full``, and of the others all but the worst filled, of ``most`` pieces together."""
    order = np.argsort(fill, kind="stable")
    again = (fill[order] < full) & (np.cumsum(count[order]) <= most)
    done = np.ones(len(fill), bool)
    done[order[again]] = False
    return done


def _pack(level: int, last: bool, refill: float, most: int, o: dict):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row", "piece"], ascending=[False, True, True], kind="stable")
        n = pdf["length"].to_numpy(np.int64)
        bins = best_fit(n, **o)
        fill = np.bincount(bins, n)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(n[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(n) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(first, ends - n[order], 0))
        place = np.empty(len(n), np.int64)
        place[order] = ends - n[order] - base
        done = np.ones(len(n), bool) if last else _closed(fill, np.bincount(bins), full=refill * o["tokens"], most=most)[bins]
        group = int(pdf["_group"].iloc[0])
        return pdf.assign(sequence_id=(level << 58) + (group << 24) + bins, offset=place, _done=done)

    return one


def pack_pieces(pieces: DataFrame, *, tokens: int = 4096, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), score: str = "norm", group_rows: int = 10_000, fan: int = 16, refill: float = 0.995, scratch: Scratch | None = None) -> DataFrame:
    """pieces: (_row long, piece int, length long <= tokens, ...). Adds sequence_id and offset (longs).

    ``documents`` and ``attention`` are the other two capacities; left out they are as loose as ``tokens`` makes
    them. Groups are cut by a hash, so equal lengths, repeated rows and hot sources spread; a group holds about
    ``group_rows`` pieces at every level. Sequences under ``refill`` of the tokens are opened again, the worst filled first, as
    far as their pieces are one in ``fan`` of ``group_rows``. No pieces give no rows.
    """
    ship(pieces.sparkSession)
    scratch = scratch or Scratch(pieces.sparkSession)
    o = {"tokens": tokens, "documents": documents or tokens, "attention": attention or float(tokens) ** 2, "weights": weights, "score": score}
    alone = pieces.where(F.col("length") == tokens)
    rest = pieces.where(F.col("length") < tokens)
    n = rest.count()
    groups = max(1, math.ceil(n / group_rows))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # A full piece is a sequence; its number can't meet those below, whose level is in the highest bits.
    out = alone.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    current = rest.withColumn("_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)).cast("long"))
    level = 0
    while n:
        last = groups == 1
        made = current.groupBy("_group").applyInPandas(_pack(level, last, refill, max(1, group_rows // fan), o), schema + ", _group long, sequence_id long, offset long, _done boolean")
        made = scratch.save(made)
        out = out.union(made.where("_done").drop("_group", "_done"))
        if last:
            break
        groups, level = math.ceil(groups / fan), level + 1
        current = made.where("NOT _done").drop("sequence_id", "offset", "_done").withColumn("_group", F.floor(F.col("_group") / fan))
    return out


def _cutter(path: str, drops_space: bool, end_id: int, tokens: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.tokens import encoder, slices
        from bytelens.llm.tidy import tidy

        enc = encoder(path, drops_space=drops_space)
        for batch in batches:
            text = batch.column("_text").cast(pa.string())
            size = np.maximum(1, np.diff(np.asarray(text.buffers()[1]).view(np.int32)[text.offset : text.offset + len(text) + 1])) if len(text) else np.zeros(0, int)
            for a, b in slices(size, 3_000_000):
                ids, ends = enc.encode(text.slice(a, b - a))
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), tokens)):
                        part = own[s : s + tokens]
                        row.append(a + i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part)
                at = pa.array(row, pa.int64())
                cols = {c: batch.column(c).take(at) for c in batch.schema.names if c != "_text"}
                cols |= {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
        tidy()

    return cut


def cut_documents(docs: DataFrame, tokenizer: str, *, drops_space: bool, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokens: int = 4096, keep_ids: bool = False) -> DataFrame:
    """(_row, id, piece, start, length, ids_crc32[, ids]): every document encoded whole, its end id added, in pieces.

    Null text counts as empty, which is the end id alone. ``_row`` tells rows with equal ids apart.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_row long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_cutter(tokenizer, drops_space, end_id, tokens, keep_ids), schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, drops_space: bool, tokens: int = 4096, keep_ids: bool = False, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece and its place in a sequence.

    Each row of docs is packed once, repeated rows too; extra columns are ignored; no documents give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    with small_batches(docs.sparkSession):
        pieces = scratch.save(cut_documents(docs, tokenizer, drops_space=drops_space, id_col=id_col, text_col=text_col, end_id=end_id, tokens=tokens, keep_ids=keep_ids))
    slim = pieces.select("_row", "piece", "length")
    placed = pack_pieces(slim, tokens=tokens, scratch=scratch, **options).drop("length")
    return pieces.join(placed, ["_row", "piece"]).drop("_row")
