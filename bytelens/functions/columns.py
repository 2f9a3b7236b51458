"""The functions of one payload as column expressions.

Null in gives null out; an empty payload has a defined value. Text goes in as UTF-8. What byte order fixes runs in
Arrow batches; everything else is built from Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from bytelens.functions import chunking, codecs, formats, hashes, lockstep, payload, search, similar, sketches


def utf8(text: Column | str) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def _each(f: Callable, kind: str, out: pa.DataType) -> Callable[[Column], Column]:
    def g(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in col.to_pylist()], out)

    # Made at each call: a worker that imports this module has no session.
    return lambda c: arrow_udf(g, kind)(c)


def _all(f: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, out: pa.DataType) -> Callable[[Column], Column]:
    """f takes the payloads of a slice at a time: their bytes, and where each begins."""

    def g(col: pa.Array) -> pa.Array:
        raw, at = lockstep.flat(col)
        got = [f(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in lockstep.slices(at, 4_000_000)]
        values = np.concatenate(got) if got else np.zeros(0, np.int64)
        return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), out, mask=col.is_null().to_numpy(zero_copy_only=False))

    return lambda c: arrow_udf(g, kind)(c)


def _struct(**fields: str) -> tuple[str, pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">", pa.struct([(k, kinds[v]) for k, v in fields.items()])


def _fields(kind: tuple[str, pa.DataType], values: tuple) -> dict:
    return dict(zip([f.name for f in kind[1]], values, strict=True))


_LONGS = ("array<bigint>", pa.list_(pa.int64()))
byte_counts = _each(lambda x: payload.counts(_array(x)), *_LONGS)
_RUNS = _struct(total="long", transitions="long", longest_run="long", runs_ge4="long", bytes_in_runs="long")
run_lengths = _each(lambda x: _fields(_RUNS, payload.runs(_array(x))), *_RUNS)
_CLASSES = _struct(whitespace="long", printable="long", control="long", high="long")
byte_classes = _each(lambda x: _fields(_CLASSES, payload.classes(_array(x))), *_CLASSES)
_MOMENTS = _struct(n="long", mean="double", variance="double", skewness="double", kurtosis="double")
byte_moments = _each(lambda x: _fields(_MOMENTS, payload.moments(_array(x))), *_MOMENTS)
_STRUCTURE = _struct(total="long", transitions="long", longest_run="long", run_fraction="double", transition_rate="double", whitespace="long", printable="long", control="long", high="long", zeros="long", distinct="long", period="long", zero_pages="long", utf8_valid="boolean")
structure = _each(lambda x: payload.structure(_array(x)), *_STRUCTURE)
_ENTROPIES = _struct(h1="double", h_min="double", h2="double", h_next="double", renyi2="double")


def _entropies(raw: bytes) -> dict:
    b = _array(raw)
    c = payload.counts(b)
    return _fields(_ENTROPIES, (payload.entropy(c), payload.min_entropy(c), payload.joint_entropy(b), payload.conditional_entropy(b), payload.renyi(c, 2)))


entropies = _each(_entropies, *_ENTROPIES)


def ngram_entropy(c: Column, n: int) -> Column:
    """Bits of the windows of n <= 8 bytes; 0 of a shorter payload."""
    return _each(lambda x: payload.ngram_entropy(_array(x), n), "double", pa.float64())(c)


_EXTENT = _struct(h1="double", h4="double", rl_fraction="double", top16_coverage="double", byte_entropy_skew="double")
extent_fingerprint = _each(lambda x: _fields(_EXTENT, payload.extent_fingerprint(_array(x))), *_EXTENT)
extent_fingerprint_exact = _each(lambda x: _fields(_EXTENT, payload.extent_fingerprint(_array(x), exact=True)), *_EXTENT)
_BLOCKS = ("array<struct<block:int,h1_q4:int,h4_q4:int,runs:int,top4:int,classes:int>>", pa.struct([(k, pa.int32()) for k in ("block", "h1_q4", "h4_q4", "runs", "top4", "classes")]))


def _blocks(col: pa.Array) -> pa.Array:
    raw, at = lockstep.flat(col)
    n = np.diff(at) // 256
    out = []
    for a, b in lockstep.slices(at, 1_000_000):
        whole = [raw[at[i] : at[i] + 256 * n[i]] for i in range(a, b)]
        rows = np.concatenate(whole).reshape(-1, 256)
        number = np.concatenate([np.arange(k) for k in n[a:b]])
        got = payload.block_fingerprints(rows) if len(rows) else np.zeros((0, 5), np.int64)
        out.append(pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (number, *got.T)], fields=list(_BLOCKS[1])))
    values = pa.concat_arrays(out) if out else pa.array([], _BLOCKS[1])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), values, mask=col.is_null() if col.null_count else None)


def block_fingerprints(c: Column) -> Column:
    """An entry for each whole block of 256 bytes."""
    return arrow_udf(_blocks, _BLOCKS[0])(c)


representation_hint = _each(lambda x: payload.hint(_array(x)), "string", pa.string())
_UTF8 = _struct(valid="boolean", valid_up_to="long", error_len="long")
validate_utf8 = _each(lambda x: _fields(_UTF8, payload.utf8(x)), *_UTF8)
_FORMAT = _struct(format="string", offset="int", length="int", confidence="int")
detect_format = _each(lambda x: _fields(_FORMAT, formats.detect(x)), *_FORMAT)


def _lookup(format_col: Column, k: int) -> Column:
    pairs = [x for name, v in formats.FORMATS.items() for x in (F.lit(name), F.lit(v[k]) if v[k] is not None else F.lit(None).cast("string"))]
    return F.create_map(*pairs)[format_col]


def mime(format_col: Column) -> Column:
    return _lookup(format_col, 0)


def category(format_col: Column) -> Column:
    return _lookup(format_col, 1)


def is_compressible(format_col: Column) -> Column:
    return _lookup(format_col, 2)


fnv1a64 = _all(hashes.fnv1a64_all, "bigint", pa.int64())
crc32c_raw = _all(payload.crc32c_all, "bigint", pa.int64())
blake3 = _each(hashes.blake3, "binary", pa.binary())
blake3_cid = _each(hashes.blake3_cid, "string", pa.string())
base32_lower = _each(hashes.base32, "string", pa.string())


def mix64(c: Column, seed: int) -> Column:
    return _all(lambda raw, at: hashes.mix64_all(raw, at, seed), "bigint", pa.int64())(c)


def sha256_multihash(c: Column) -> Column:
    return F.concat(F.unhex(F.lit("1220")), F.unhex(F.sha2(c, 256)))


def sha256_cid(c: Column) -> Column:
    """CIDv1 of raw content; the digest is Spark's."""
    return F.concat(F.lit("b"), base32_lower(F.concat(F.unhex(F.lit("0155")), sha256_multihash(c))))


def ngram_bins(c: Column, n: int, bins: int) -> Column:
    return _each(lambda x: payload.hash_bins(_array(x), n, bins), *_LONGS)(c)


def chunks(c: Column, sizes: chunking.ChunkSizes) -> Column:
    """An entry for each content-defined chunk."""
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())])

    def f(col: pa.Array) -> pa.Array:
        raw, at = lockstep.flat(col)
        starts, ends, marks, n = [], [], [], [0]
        for a, b in lockstep.slices(at, 4_000_000):
            h = chunking.gear_hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            for i in range(a, b):
                own = h[at[i] - at[a] : at[i + 1] - at[a]]
                e = chunking.cuts(own, sizes)
                ends += e
                starts += [0, *e[:-1]] if e else []
                marks.append(own[np.array(e, np.int64) - 1] if e else own)
                n.append(len(e))
        mark = np.concatenate(marks).view(np.int64) if marks else np.zeros(0, np.int64)
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(mark)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), values, mask=col.is_null() if col.null_count else None)

    return arrow_udf(f, "array<struct<start:bigint,end:bigint,hash:bigint>>")(c)


_CTPH = _struct(blocksize="long", body="string", body2="string")
ctph = _each(lambda x: _fields(_CTPH, similar.ctph(x)), *_CTPH)
quartile_digest = _each(similar.quartile_digest, "binary", pa.binary())


def ctph_similarity(a: Column, b: Column) -> Column:
    @arrow_udf("int")
    def g(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else similar.ctph_similarity(tuple(p.values()), tuple(q.values())) for p, q in rows], pa.int32())

    return g(a, b)


def find_all(c: Column, needle: bytes) -> Column:
    return _each(lambda x: search.find_all(needle, x), *_LONGS)(c)


def find_bytes(c: Column, needle: bytes, engine: str = "two_way") -> Column:
    return _each(lambda x: search.find(needle, x, engine), "bigint", pa.int64())(c)


def find_many(c: Column, patterns: list[bytes]) -> Column:
    """(offset, pattern) of every match, by where it ends, then by pattern: one scan of a batch for all patterns."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("pattern", pa.int32())]))
    known = tuple(patterns)

    def f(col: pa.Array) -> pa.Array:
        from bytelens.functions.automaton import automaton

        raw, at = lockstep.flat(col)
        lists = []
        for a, b in lockstep.slices(at, 4_000_000):
            doc, offset, number = automaton(known).scan(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            places = pa.StructArray.from_arrays([pa.array(offset, pa.int64()), pa.array(number, pa.int32())], ["offset", "pattern"])
            missing = col.slice(a, b - a).is_null()
            lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), places, mask=missing))
        return pa.concat_arrays(lists) if lists else pa.array([], kind)

    return arrow_udf(f, "array<struct<offset:bigint,pattern:int>>")(c)


def minhash_bytes(c: Column, seeds: list[int]) -> Column:
    """Slots in the order of unsigned numbers, as longs; null slots for an empty payload."""
    table = similar.byte_table(np.array(seeds, np.uint64))

    def f(x: bytes) -> list:
        slots, there = similar.minhash_bytes(_array(x), table)
        return [int(s) if t else None for s, t in zip(slots.view(np.int64), there, strict=True)]

    return _each(f, *_LONGS)(c)


def simhash_bytes(c: Column, seeds: list[int]) -> Column:
    s = np.array(seeds, np.uint64)
    return _each(lambda x: hashes.signed(similar.simhash_bytes(_array(x), s)), "bigint", pa.int64())(c)


# Codecs -----------------------------------------------------------------------------------------


def _numbers(x: list) -> np.ndarray:
    return np.array(x, np.int64)


def bit_pack(values: Column, width: int) -> Column:
    """An array of numbers in ``width`` bits each, lowest first."""
    return _each(lambda x: codecs.bit_pack(_numbers(x), width), "binary", pa.binary())(values)


def bit_unpack(packed: Column, width: int, n: Column) -> Column:
    """The first n numbers of ``bit_pack``; null where fewer are there."""
    f = lambda x, k: codecs.bit_unpack(x, width, k).astype(np.int64) if width * k <= 8 * len(x) else None
    return _pairs(f, *_LONGS)(packed, n)


_VBYTE = ("struct<control:binary,data:binary>", pa.struct([("control", pa.binary()), ("data", pa.binary())]))


def stream_vbyte(values: Column) -> Column:
    """Control and data of an array of 32-bit numbers."""
    return _each(lambda x: dict(zip(("control", "data"), codecs.stream_vbyte(_numbers(x)), strict=True)), *_VBYTE)(values)


def stream_vbyte_decode(coded: Column, n: Column) -> Column:
    """The n numbers of ``stream_vbyte``; null where it is cut off."""

    def f(x: dict, k: int) -> np.ndarray | None:
        try:
            return codecs.stream_vbyte_decode(x["control"], x["data"], k).astype(np.int64) if 4 * len(x["control"]) >= k else None
        except ValueError:
            return None

    return _pairs(f, *_LONGS)(coded, n)


def varint(values: Column) -> Column:
    """Unsigned LEB128 of a long from 0."""
    return _each(lambda x: hashes.varint(x), "binary", pa.binary())(values)


_VARINT = _struct(value="long", length="int")


def varint_decode(raw: Column) -> Column:
    """(value, bytes read); null where it is cut off or passes 64 bits."""

    def f(x: bytes) -> dict | None:
        got = hashes.unvarint(x)
        return None if got is None else {"value": hashes.signed(got[0]), "length": got[1]}

    return _each(f, *_VARINT)(raw)


_MULTIHASH = ("struct<code:string,digest:binary>", pa.struct([("code", pa.string()), ("digest", pa.binary())]))


def multihash_decode(raw: Column) -> Column:
    """(code, digest); null where it isn't one that is known."""

    def f(x: bytes) -> dict | None:
        got = hashes.unmultihash(x)
        return None if got is None else dict(zip(("code", "digest"), got, strict=True))

    return _each(f, *_MULTIHASH)(raw)


def blake3_output(c: Column, size: int) -> Column:
    """The first ``size`` bytes of the extendable output."""
    return _each(lambda x: hashes.blake3(x, size), "binary", pa.binary())(c)


def blake3_keyed(c: Column, key: bytes, size: int = 32) -> Column:
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return _each(lambda x: hashes.blake3(x, size, key=key), "binary", pa.binary())(c)


def blake3_derived(material: Column, context: str, size: int = 32) -> Column:
    """A key from key material, for one context."""
    return _each(lambda x: hashes.blake3(x, size, context=context), "binary", pa.binary())(material)


# Parts of payloads --------------------------------------------------------------------------------


def classes_by(c: Column, table: list[int]) -> Column:
    """16 counts under a table of 256 class numbers."""
    t = np.array(table)
    return _each(lambda x: payload.classes_by(_array(x), t), *_LONGS)(c)


def unpack_le(value: Column, n: int) -> Column:
    """The bytes of a packed window, the first lowest."""
    return F.unhex(F.substring(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", value, i * 8).bitwiseAND(F.lit(255).cast("long"))), 2, "0"))), 1, 2 * n))


def first_cut(c: Column, sizes: chunking.ChunkSizes) -> Column:
    """Length of the first content-defined chunk; 0 of an empty payload."""
    return _each(lambda x: chunking.first_cut(x, sizes), "bigint", pa.int64())(c)


_SIGNALS = _struct(n_bytes="long", h1="double", h2="double", h_next="double", h4="double", distinct="int", run_fraction="double", zeros="double", ascii="double", top16="double", period="int", hint="string")


def _signals(x: bytes) -> dict:
    b = _array(x)
    n, s, c = max(1, len(b)), payload.structure(b), payload.counts(b)
    h1 = payload.entropy(c)
    return _fields(_SIGNALS, (len(b), h1, payload.joint_entropy(b), payload.conditional_entropy(b), payload.ngram_entropy(b, 4), s["distinct"], s["run_fraction"], s["zeros"] / n, (s["whitespace"] + s["printable"]) / n, payload.top_coverage(c, 16), s["period"], payload.hint(b)))


#: What the choice of a representation looks at, in one struct.
signals = _each(_signals, *_SIGNALS)
_VECTOR = ("array<double>", pa.list_(pa.float64()))


def _features(x: bytes) -> list[float]:
    b, n = _array(x), len(x)
    if not n:
        return [0.0] * 6
    h1 = payload.entropy(payload.counts(b))
    h2 = payload.joint_entropy(b) * (n - 1) / n if n >= 2 else h1
    h3 = payload.ngram_entropy(b, 3) * (n - 2) / n if n >= 3 else h1
    top = np.sort(payload.ngram_counts(b, 4)[1])[::-1][:16].sum() * 4 / n
    return [h1, h2, h3, float(top), payload.runs(b)[4] / n, h1 / 8]


#: Entropies of one, two and three bytes, scaled to the payload's length, the share of the 16 most frequent windows of four
#: bytes times four, the share in runs of four and more, and h1 / 8; zeros of an empty payload.
feature_vector = _each(_features, *_VECTOR)


def heavy_bytes(c: Column, k: int) -> Column:
    """Misra-Gries over a payload's bytes with k counters: (byte, count), counts too low by n / (k + 1) at most."""
    kind = pa.list_(pa.struct([("byte", pa.int32()), ("count", pa.int64())]))

    def f(x: bytes) -> list[dict]:
        s = sketches.MisraGries(k)
        for v in x:
            s.update(v)
        return [{"byte": b, "count": n} for b, n in sorted(s.counts.items())]

    return _each(f, "array<struct<byte:int,count:bigint>>", kind)(c)


# Similarity ---------------------------------------------------------------------------------------


def _pairs(f: Callable, kind: str, out: pa.DataType) -> Callable[[Column, Column], Column]:
    def g(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else f(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], out)

    return lambda a, b: arrow_udf(g, kind)(a, b)


def ctph_distance(a: Column, b: Column) -> Column:
    """100 less the similarity."""
    return 100 - ctph_similarity(a, b)


def quartile_distance(a: Column, b: Column) -> Column:
    """0 for equal digests; the largest 32-bit number if either is null."""

    def g(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar.quartile_distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())

    return arrow_udf(g, "bigint")(a, b)


def relatedness(a: Column, b: Column, da: Column, db: Column) -> Column:
    """0 to 1, half of each digest: a and b of ``ctph``, da and db of ``quartile_digest``."""
    return F.lit(0.5) * (1 - F.least(F.lit(1.0), quartile_distance(da, db) / 150)) + F.lit(0.5) * ctph_similarity(a, b) / 100


def simhash_items(items: Column, weights: Column | None = None, seed: int = 0) -> Column:
    """64 bits over the mix64 of an array of strings; each item votes with its weight, 1 without any."""

    def bits(x: list, w: list | None) -> int:
        there = [i for i, s in enumerate(x) if s is not None]
        h = np.array([hashes.mix64(x[i].encode(), seed) for i in there], np.uint64)
        return hashes.signed(similar.simhash(h, None if w is None else np.array([w[i] or 0 for i in there], np.int64)))

    def votes(col: pa.Array) -> pa.Array:
        """All rows of a batch at a time."""
        size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, int)
        size = np.where(col.is_valid().to_numpy(zero_copy_only=False), size, 0)
        flat = col.flatten()
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(col)), size)[there]
        h = hashes.mix64_all(*lockstep.flat(flat.cast(pa.binary())), seed)[there]
        ends = np.cumsum(np.bincount(row, minlength=len(col)))
        ones, n = np.zeros((len(col), 64), np.int64), np.diff(ends, prepend=0)
        for a, b in lockstep.slices(np.r_[0, ends], 100_000):
            own = slice(ends[a] - n[a], ends[b - 1])
            full = a + np.flatnonzero(n[a:b])
            if len(full):
                one = np.unpackbits(h[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[full] = np.add.reduceat(one, ends[full] - n[full] - own.start, axis=0, dtype=np.int64)
        out = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
        return pa.array(out, pa.int64(), mask=col.is_null().to_numpy(zero_copy_only=False))

    if weights is None:
        return arrow_udf(votes, "bigint")(items)
    return _pairs(bits, "bigint", pa.int64())(items, weights)


def simhash_bands(bits: Column, bands: int) -> Column:
    """Keys of a 64-bit signature cut into ``bands`` runs of bits."""
    width = 64 // bands
    mask = F.lit((1 << width) - 1).cast("long")
    return F.array(*[F.shiftrightunsigned(bits, i * width).bitwiseAND(mask) for i in range(bands)])


# Places in sketches -------------------------------------------------------------------------------


def count_min_places(item: Column, rows: int = 4, cols: int = 1024) -> Column:
    """The cell of a 32-bit number in each row of a Count-Min table."""

    def g(col: pa.Array) -> pa.Array:
        there = col.is_valid().to_numpy(zero_copy_only=False)
        cells = sketches.count_min_cells(col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32), rows, cols)
        return pa.array([c if t else None for c, t in zip(cells.T.tolist(), there, strict=True)], pa.list_(pa.int64()))

    return arrow_udf(g, "array<bigint>")(item.cast("long"))


def bloom_places(item: Column, shape: sketches.Bloom) -> Column:
    """The places of a payload in a Bloom filter of this shape."""
    return _each(lambda x: shape.positions(x).astype(np.int64), *_LONGS)(item)


def distance_code(d: Column) -> Column:
    """An unsigned 32-bit number that orders as the single-precision distance does; the largest for NaN."""

    def g(col: pa.Array) -> pa.Array:
        x = col.cast(pa.float32()).fill_null(0).to_numpy(zero_copy_only=False)
        bits = x.view(np.uint32)
        code = np.where(bits >> np.uint32(31), ~bits, bits ^ np.uint32(1 << 31))
        return pa.array(np.where(np.isnan(x), np.uint32(0xFFFFFFFF), code).astype(np.int64), mask=col.is_null().to_numpy(zero_copy_only=False))

    return arrow_udf(g, "bigint")(d.cast("float"))


# Sets in containers ------------------------------------------------------------------------------


def container_set(values: Column) -> Column:
    """The set of an array of longs in its binary form (see ``functions.containers``); nulls and what isn't 32 bits are left out."""
    from bytelens.functions import containers

    def f(col: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, int)
        known = col.is_valid().to_numpy(zero_copy_only=False)
        flat = col.flatten()
        there, v = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.where(known, size, 0)).tolist()
        return pa.array([containers.pack(v[a:b][there[a:b]]) if ok else None for ok, a, b in zip(known.tolist(), [0, *ends], ends, strict=False)], pa.binary())

    return arrow_udf(f, "binary")(values)


def _container(kind: str, out: pa.DataType, name: str, *args) -> Callable[[Column], Column]:
    from bytelens.functions import containers

    return _each(lambda x: getattr(containers, name)(x, *args), kind, out)


def container_members(c: Column) -> Column:
    """The numbers, rising."""
    from bytelens.functions import containers

    return _each(lambda x: containers.unpack(x).tolist(), *_LONGS)(c)


def container_size(c: Column) -> Column:
    return _container("bigint", pa.int64(), "cardinality")(c)


def container_has(c: Column, x: int) -> Column:
    return _container("boolean", pa.bool_(), "contains", x)(c)


def container_problem(c: Column) -> Column:
    """What is wrong with a set's form; null of a sound one and of null."""
    return _container("string", pa.string(), "problem")(c)


_MEETS = _struct(size_and="long", size_or="long", size_minus="long", size_xor="long", total_and="long", problem="string")


def container_meets(a: Column, b: Column) -> Column:
    """How many numbers and, or, minus and xor of two sets have, the sum of those of and, and what is wrong with the form of one of
    the four; each is merged once. Null where either is."""
    from bytelens.functions import containers

    def one(p: bytes, q: bytes) -> tuple:
        made = containers.merges(("and", "or", "minus", "xor"), p, q)
        wrong = next((w for w in map(containers.problem, made) if w), None)
        return (*map(containers.cardinality, made), int(containers.unpack(made[0]).sum()), wrong)

    return _pairs(lambda p, q: _fields(_MEETS, one(p, q)), *_MEETS)(a, b)


def container_merge(op: str, a: Column, b: Column) -> Column:
    """and, or, minus or xor of two sets, without leaving the binary form; null where either is."""
    from bytelens.functions import containers

    def f(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else containers.merge(op, p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.binary())

    return arrow_udf(f, "binary")(a, b)


def run_totals(state: Column) -> Column:
    """The run lengths that a state of ``operators.segments`` stands for, in the form of ``run_lengths``."""
    from bytelens.operators.segments import runs_total

    return _each(lambda x: _fields(_RUNS, runs_total(x)), *_RUNS)(state)
