"""Column forms against the kernels they wrap and against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelens.functions import bits as fb
from bytelens.functions import chunking, hashes, lockstep, similar
from bytelens.functions import columns as fc
from bytelens.functions import payload as pl
from bytelens.operators import content, graphs, neighbours, sketching

RNG = random.Random(5)
RAW = [None, b"", b"a", b"abcdefgh", b"\0" * 17, bytes(range(256)), bytes(RNG.randrange(256) for _ in range(5000)), b"hello " * 90] + [bytes(RNG.randrange(256) for _ in range(RNG.randrange(60))) for _ in range(40)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(RAW)], "id int, x binary").repartition(2)


def values(df, c):
    return [r["v"] for r in df.select("id", c.alias("v")).orderBy("id").collect()]


def each(f):
    return [None if x is None else f(x) for x in RAW]


def test_hashes_of_many_payloads(raw):
    x = F.col("x")
    assert values(raw, fc.fnv1a64(x)) == each(lambda b: hashes.signed(hashes.fnv1a64(b)))
    assert values(raw, fc.crc32c_raw(x)) == each(pl.crc32c)
    assert values(raw, fc.mix64(x, 77)) == each(lambda b: hashes.signed(hashes.mix64(b, 77)))
    flat, at = lockstep.flat(__import__("pyarrow").array([b for b in RAW if b is not None], "binary"))
    assert pl.crc32c_all(flat, at, 9).tolist() == [pl.crc32c(b, 9) for b in RAW if b is not None]


def plain_chunks(raw, sizes):
    """Byte by byte, as the definition says."""
    out, h, start = [], 0, 0
    strict, loose = sizes.masks()
    normal = sizes.avg_size if sizes.level else sizes.max_size
    while start < len(raw):
        end = min(len(raw), start + sizes.max_size)
        for k in range(end - start):
            h = chunking.gear_update(h, raw[start + k])
            if k >= sizes.min_size and not h & (strict if k < normal else loose):
                end = start + k + 1
                break
        out.append((start, end, h))
        start = end
    return out


@pytest.mark.parametrize("sizes", [chunking.ChunkSizes.around(64), chunking.ChunkSizes.around(64, 1), chunking.ChunkSizes(20, 100, 150, 2), chunking.ChunkSizes(1, 1, 1)])
def test_chunks(raw, sizes):
    got = values(raw, fc.chunks(F.col("x"), sizes))
    assert [None if v is None else [(r["start"], r["end"], r["hash"] % 2**64) for r in v] for v in got] == each(lambda b: plain_chunks(b, sizes))
    assert values(raw, fc.first_cut(F.col("x"), sizes)) == each(lambda b: next((e for _, e, _ in plain_chunks(b, sizes)), 0))


def test_block_fingerprints(spark):
    rng = np.random.default_rng(0)
    blocks = [bytes(256), bytes(range(256)), rng.integers(0, 4, 256).astype(np.uint8).tobytes(), b"aaaab" * 51 + b"c", rng.integers(0, 256, 256).astype(np.uint8).tobytes(), b"The quick brown fox " * 12 + b"jumps over lazy.."[:16]]
    df = spark.createDataFrame([(1, bytearray(b"".join(blocks) + b"tail")), (2, bytearray(b"short")), (3, None), (4, bytearray())], "id int, x binary")
    got = values(df, fc.block_fingerprints(F.col("x")))
    assert got[1] == [] and got[2] is None and got[3] == [] and [r["block"] for r in got[0]] == list(range(6))
    for r, b in zip(got[0], blocks, strict=True):
        a = np.frombuffer(b, np.uint8)
        c = np.bincount(a, minlength=256)
        runs = pl.runs(a)[3]
        h1 = np.float32(pl.entropy(c))
        h4 = h1 if h1 >= 7.875 and runs == 0 else np.float32(pl.entropy(pl.hash_bins(a, 4, 256)))
        q = lambda h: min(255, int(np.floor(float(h) * 16 + 0.5)))
        assert (r["h1_q4"], r["h4_q4"], r["runs"], r["top4"]) == (q(h1), q(h4), runs, min(255, int(np.sort(c)[-4:].sum())))


def test_codecs_come_back(spark):
    rows = [(1, [0, 1, 255, 256, 65535, 70000, 2**31 - 1]), (2, []), (3, None), (4, [7])]
    d = spark.createDataFrame(rows, "id int, x array<long>")
    n = F.size("x")
    assert values(d, fc.bit_unpack(fc.bit_pack(F.col("x"), 31), 31, n)) == [r[1] for r in rows]
    assert values(d, fc.stream_vbyte_decode(fc.stream_vbyte(F.col("x")), n)) == [r[1] for r in rows]
    assert values(d.where("id = 1"), fc.bit_unpack(fc.bit_pack(F.col("x"), 31), 31, n + 9)) == [None]
    assert values(d.where("id = 1"), fc.stream_vbyte_decode(fc.stream_vbyte(F.col("x")), n + 9)) == [None]
    v = spark.createDataFrame([(i, x) for i, x in enumerate([0, 127, 128, 2**62])], "id int, x long")
    assert [r["value"] for r in values(v, fc.varint_decode(fc.varint(F.col("x"))))] == [0, 127, 128, 2**62]
    cut = spark.createDataFrame([(0, bytearray(b"\x80")), (1, bytearray()), (2, None)], "id int, x binary")
    assert values(cut, fc.varint_decode(F.col("x"))) == [None] * 3 and values(cut, fc.multihash_decode(F.col("x"))) == [None] * 3


def test_digests(raw):
    x = F.col("x")
    assert [None if v is None else bytes(v) for v in values(raw, fc.blake3_output(x, 70))] == each(lambda b: hashes.blake3(b, 70))
    assert [None if v is None else bytes(v) for v in values(raw, fc.blake3_keyed(x, b"k" * 32))] == each(lambda b: hashes.blake3(b, key=b"k" * 32))
    assert [None if v is None else bytes(v) for v in values(raw, fc.blake3_derived(x, "one"))] == each(lambda b: hashes.blake3(b, context="one"))
    with pytest.raises(ValueError):
        fc.blake3_keyed(x, b"short")
    d = raw.select("id", fc.ctph(x).alias("c"), fc.quartile_digest(x).alias("q"))
    p = d.join(d.where("id = 7").select(F.col("c").alias("c7"), F.col("q").alias("q7")))
    c, q = each(similar.ctph), each(similar.quartile_digest)
    assert values(p, fc.ctph_distance(F.col("c"), F.col("c7"))) == [None if v is None else 100 - similar.ctph_similarity(v, c[7]) for v in c]
    assert values(p, fc.quartile_distance(F.col("q"), F.col("q7"))) == [similar.quartile_distance(v, q[7]) for v in q]
    assert values(p, fc.relatedness(F.col("c"), F.col("c7"), F.col("q"), F.col("q7"))) == [None if v is None else pytest.approx(similar.relatedness(v, c[7], w, q[7])) for v, w in zip(c, q, strict=True)]


def test_parts_of_payloads(raw):
    x = F.col("x")
    table = [i // 16 for i in range(255)] + [99]
    assert values(raw, fc.classes_by(x, table)) == each(lambda b: [sum(table[v] == k for v in b) for k in range(16)])
    s = values(raw, fc.signals(x))
    assert s[0] is None and s[1]["hint"] == "empty" and s[5]["h1"] == pytest.approx(8) and s[4]["zeros"] == 1
    f = values(raw, fc.feature_vector(x))
    assert f[0] is None and f[1] == [0.0] * 6 and f[2] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] and f[5][0] == pytest.approx(8) and f[4][3] == pytest.approx(14 * 4 / 17) and f[4][4] == 1
    for got, b in zip(values(raw, fc.heavy_bytes(x, 3)), RAW, strict=True):
        for r in got or []:
            assert b.count(r["byte"]) - len(b) / 4 <= r["count"] <= b.count(r["byte"])
    p = raw.sparkSession.createDataFrame([(0, 0x0403020100), (1, -1)], "id int, v long")
    assert [bytes(v) for v in values(p, fc.unpack_le(F.col("v"), 5))] == [bytes(range(5)), b"\xff" * 5]


def test_bits(spark):
    rows = [(0, [0, 63, 64, 100, 127]), (1, []), (2, None), (3, [5, 5, 200, -1])]
    d = spark.createDataFrame(rows, "id int, x array<long>").withColumn("w", fb.bitmap(F.col("x"), 128))
    w = F.col("w")
    sets = [None if x is None else sorted({v for v in x if 0 <= v < 128}) for _, x in rows]
    assert values(d, fb.members(w)) == sets and values(d, fb.popcount(w)) == [None if s is None else len(s) for s in sets]
    for place in (0, 1, 63, 64, 65, 128):
        assert values(d, fb.rank1(w, F.lit(place))) == [None if s is None else sum(v < place for v in s) for s in sets], place
    for k in (0, 1, 4, 99):
        assert values(d, fb.select1(w, F.lit(k))) == [None if s is None or k >= len(s) else s[k] for s in sets]
        assert values(d, fb.select0(w, F.lit(k))) == [None if s is None else [v for v in range(128) if v not in s][k] for s in sets]
    assert values(d, fb.rank1(w, F.lit(129))) == [None] * 4 and values(d, fb.select1(w, F.lit(-1))) == [None] * 4
    assert values(d.where("id = 0"), fb.members(fb.remove(fb.insert(w, F.lit(70)), F.lit(63)))) == [[0, 64, 70, 100, 127]]
    assert values(d.where("id = 0"), fb.bit_and(w, F.array(F.lit(1).cast("long")))) == [None]


def test_simhash_columns(spark):
    d = spark.createDataFrame([(0, ["a", "b", None], [3, 1, 9]), (1, [], []), (2, None, None)], "id int, x array<string>, w array<long>")
    h = lambda *x: np.array([hashes.mix64(s.encode(), 4) for s in x], np.uint64)
    assert values(d, fc.simhash_items(F.col("x"), seed=4)) == [hashes.signed(similar.simhash(h("a", "b"))), 0, None]
    assert values(d, fc.simhash_items(F.col("x"), F.col("w"), seed=4)) == [hashes.signed(similar.simhash(h("a", "b"), np.array([3, 1]))), 0, None]
    one = values(d.where("id = 0"), fc.simhash_bands(fc.simhash_items(F.col("x"), seed=4), 4))[0]
    assert one == similar.simhash_bands(similar.simhash(h("a", "b")), 4)
    n = spark.createDataFrame([(i, b) for i, b in enumerate([0, 1, 3, -1, -2])], "id long, s long")
    got = {tuple(r) for r in neighbours.simhash_pairs(n, "id", F.col("s"), most=2, bands=8).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (1, 2, 1), (3, 4, 1)}


def test_minhash_merges(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, []), (3, None)], "k int, w array<string>")
    got = {r["k"]: r["slots"] for r in content.merged_minhash(d, F.col("w"), ["k"], 16, 3).collect()}
    whole = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>").select(content.minhash(F.col("w"), 16, 3).alias("m")).first()["m"]
    assert got == {1: whole}


def test_space_saving_bounds(spark):
    d = spark.range(20_000).select((F.col("id") % 7 * F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("x")).repartition(5)
    held = {r["item"]: r for r in sketching.heavy_hitters(d, F.col("x"), 20, "space_saving").collect()}
    for r in d.groupBy("x").count().where("count > 1000").collect():
        assert held[r["x"]]["low"] <= r["count"] <= held[r["x"]]["high"]
    with pytest.raises(ValueError):
        sketching.heavy_hitters(d, F.col("x"), 20, "other")


def test_hll_estimates_agree(spark):
    from bytelens.functions.sketches import hll_estimate

    for p, rank in ((4, 30), (12, 1), (12, 20)):
        m = 1 << p
        regs = spark.createDataFrame([(i, rank) for i in range(m)], "idx long, rank int")
        assert sketching.hll_estimate(regs, p).first()["estimate"] == hll_estimate(m, m * 2.0**-rank, 0)


def test_fold_keeps_its_leaves_apart(spark, monkeypatch):
    from bytelens.operators import folds

    d = spark.range(64).select(F.col("id").cast("string").cast("binary").alias("x")).repartition(20)
    total = lambda a, b: (int(a) + int(b)).__str__().encode()
    assert folds.fold(d, F.col("x"), lambda r: r, total, b"0", fan=3) == str(sum(range(64))).encode()


def test_graph_tables(spark):
    ok = spark.createDataFrame([(0, 0, [1, 2]), (1, 2, [0]), (2, 3, [0])], "id long, start long, neighbours array<long>")
    assert graphs.check_csr(ok).collect() == []
    bad = spark.createDataFrame([(0, 0, [2, 1]), (1, 3, [7])], "id long, start long, neighbours array<long>")
    assert {tuple(r) for r in graphs.check_csr(bad).collect()} == {(0, "order"), (1, "start"), (0, "neighbour"), (1, "neighbour")}
    o = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, new_id long")
    graphs.check_permutation(o)
    assert sorted(tuple(r) for r in graphs.invert(o).collect()) == [(0, 1), (1, 2), (2, 0)]
    for wrong in ([(0, 0), (1, 0)], [(0, 1), (1, 2)], [(0, 0), (0, 1)]):
        with pytest.raises(ValueError):
            graphs.check_permutation(spark.createDataFrame(wrong, "id long, new_id long"))
    graphs.check_permutation(o.limit(0))


def test_set_similarity_of_copies_and_awkward_sets(spark):
    import itertools

    rng = random.Random(3)
    base = [f"t{i}" for i in range(30)]
    sets = [sorted(rng.sample(base, rng.randrange(1, 30))) for _ in range(80)]
    rows = [(i, s) for i, s in enumerate(sets)] + [(100 + i, sets[i]) for i in range(9)] + [(200, []), (201, None), (202, ["only"]), (203, ["only", "only"])]
    got = {(r["a"], r["b"]): r["jaccard"] for r in neighbours.set_similarity_join(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w"), 0.8).collect()}
    want = {}
    for (i, s), (j, t) in itertools.combinations([(i, set(s)) for i, s in rows if s], 2):
        if len(s & t) / len(s | t) >= 0.8:
            want[min(i, j), max(i, j)] = pytest.approx(len(s & t) / len(s | t))
    assert got == want


def test_distances_by_name(spark):
    from bytelens.functions import native as fn

    d = spark.createDataFrame([(0, [1, 2, 3], [3, 2, 1]), (1, [0, 0, 0], [0, 0, 0])], "id int, a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    both = values(d, fn.count_distances(a, b))
    for name in fn.DISTANCES:
        one = values(d, fn.count_distance(name, a, b))
        assert one[0] == both[0][name] and one[0] > 0 and one[1] == (1.0 if name == "cosine" else 0.0), name
    with pytest.raises(KeyError):
        fn.count_distance("other", a, b)
    big = spark.createDataFrame([(0, [2**32 - 1, 3], [2**32 - 1, 4]), (1, [2, 3], [4, 5]), (2, [1], [1, 2])], "id int, a array<long>, b array<long>")
    assert values(big, fn.dot_wrapped(a, b)) == [((2**32 - 1) ** 2 + 12) % 2**32, 23, None]
    assert values(big, fn.dot_checked(a, b)) == [None, 23, None]


def _drained(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{name}")).format("memory").queryName(name).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    from bytelens.functions.sketches import Bloom, CountMin, HyperLogLog, MisraGries, P2Quantile
    from bytelens.streaming import sequences, sketches as st

    rng = np.random.default_rng(3)
    items = rng.integers(0, 50, 400).tolist()
    df = spark.createDataFrame([("a" if i % 2 else "b", int(x), ["w%d" % (x % 9)]) for i, x in enumerate(items)], "key string, value long, w array<string>")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    text = fc.utf8(F.col("value").cast("string"))
    cm = CountMin()
    cm.update(np.array(items, np.uint32))
    assert {(r["row"], r["cell"]): r["cnt"] for r in _drained(st.count_min_cells(stream, F.col("value")), "complete", tmp_path, "cm")} == {(int(a), int(b)): int(cm.table[a, b]) for a, b in zip(*np.nonzero(cm.table), strict=True)}
    bloom = Bloom.sized(100, 0.01)
    shape = Bloom(bloom.bits, bloom.hashes)
    for x in items:
        bloom.insert(str(x).encode())
    assert {r["word"]: r["bits"] for r in _drained(st.bloom_words(stream, text, shape), "complete", tmp_path, "bl")} == {i: int(w) for i, w in enumerate(bloom.words.view(np.int64).tolist()) if w}
    byte = {(r["key"], r["byte"]): r["cnt"] for r in _drained(st.byte_histogram(stream, text, ["key"]), "complete", tmp_path, "by")}
    for key, at in (("a", 1), ("b", 0)):
        raw = "".join(str(x) for x in items[at::2]).encode()
        assert all(byte.get((key, v), 0) == raw.count(v) for v in range(48, 58))
    bins = _drained(st.hash_bins(stream, text, 1, 8, []), "complete", tmp_path, "hb")
    assert sum(r["cnt"] for r in bins) == sum(len(str(x)) for x in items)
    slots = {(r["key"], r["slot"]): r["v"] for r in _drained(st.minhash_slots(stream, F.col("w"), ["key"], 8, 3), "complete", tmp_path, "mh")}
    for r in content.merged_minhash(df, F.col("w"), ["key"], 8, 3).collect():
        assert [slots[r["key"], i] ^ -(1 << 63) for i in range(8)] == r["slots"]
    hll = HyperLogLog(6)
    for x in items:
        hll.insert(str(x).encode())
    h = fc.mix64(text, 0xC8C25E0F2C5C3F6D)
    rest = F.shiftleft(h, 6)
    rank = F.when(rest == 0, F.lit(59)).otherwise(65 - F.length(F.bin(rest)))
    regs = _drained(st.register_maxima(stream, F.shiftrightunsigned(h, 58), rank, []), "complete", tmp_path, "hl")
    assert {r["idx"]: r["rank"] for r in regs} == {i: int(v) for i, v in enumerate(hll.registers) if v}
    for r in _drained(sequences.running_counters(stream, 60, 0.5), "update", tmp_path, "rc"):
        own = items[1 if r["key"] == "a" else 0 :: 2]
        mg = MisraGries(60)
        for x in own:
            mg.update(x)
        assert r["n"] == len(own) and dict(zip(r["items"], r["counts"], strict=True)) == mg.counts
        assert r["quantile"] == pytest.approx(P2Quantile(0.5).update_all(map(float, own)).estimate(), rel=0.2)


def test_graph_files_and_filters(spark, tmp_path):
    from bytelens.functions import hnsw
    from bytelens.sources import files

    x = np.random.default_rng(4).normal(size=(60, 6)).astype(np.float32)
    links, entry = hnsw.build(x)
    raw = hnsw.write(list(range(100, 160)), x, links, entry)
    (tmp_path / "a.graph").write_bytes(raw)
    (tmp_path / "b.graph").write_bytes(raw[:500])
    got = {r["path"][-7:]: r for r in files.graphs(spark, str(tmp_path)).collect()}
    assert (got["a.graph"]["rows"], got["a.graph"]["dims"], got["a.graph"]["metric"], got["a.graph"]["error"]) == (60, 6, "l2_squared", None)
    assert got["b.graph"]["error"] and got["b.graph"]["rows"] is None
    permits = set(range(0, 60, 3))
    q = spark.createDataFrame([(i, bytearray(x[i].tobytes())) for i in range(10)] + [(99, None)], "id long, vector binary")
    found = files.graph_search(q, raw, k=4, ef=60, permits=permits).collect()
    for i in range(10):
        d = ((x - x[i]) ** 2).sum(1)
        assert [r["key"] - 100 for r in sorted(found, key=lambda r: r["rank"]) if r["id"] == i] == sorted(permits, key=lambda k: d[k])[:4]
    g = hnsw.read(raw)
    assert hnsw.selectivity(g, permits) == pytest.approx(1 / 3) and hnsw.select([(2.0, 1), (1.0, 5), (1.0, 3)], 2) == [(1.0, 3), (1.0, 5)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate([-2.5, -0.0, 0.0, 1e-9, 3.0, float("inf"), None, float("nan")])], "id int, d double")
    code = values(d, fc.distance_code(F.col("d")))
    assert code[:6] == sorted(code[:6]) and code[2] == 1 << 31 and code[6] is None and code[7] == 2**32 - 1


def test_synthetic_rows(spark):
    from bytelens.functions import native as fn
    from bytelens.sources import synthetic

    d = synthetic.corpus(spark, 70, size=2048)
    s, f = fc.structure(F.col("payload")), fc.extent_fingerprint(F.col("payload"))
    rows = d.select("id", "kind", "payload", s.alias("s"), f.alias("f")).select("kind", "payload", fn.is_zero_filled(F.col("s")).alias("zero"), fn.is_sparse(F.col("s")).alias("sparse"), fn.is_low_cardinality(F.col("s")).alias("few"), fn.is_text_like(F.col("s")).alias("text"), fn.skips_compression(F.col("f")).alias("skip"), F.col("s.period").alias("period"), F.col("s.run_fraction").alias("runs")).collect()
    assert len(rows) == 70 and sorted(bytes(r["payload"]) for r in rows) == sorted(bytes(r["payload"]) for r in d.repartition(7).collect())
    for r in rows:
        assert r["zero"] == (r["kind"] == "zeros") and r["sparse"] == (r["kind"] in ("zeros", "sparse")) and r["text"] == (r["kind"] == "text")
        assert r["few"] >= (r["kind"] in ("zeros", "few")) and (r["kind"] != "runs" or r["runs"] > 0.9) and (r["kind"] != "period" or r["period"] == 64) and (not r["skip"] or r["kind"] == "random")
    v = synthetic.vectors(spark, 40, clusters=4).collect()
    x = np.array([r["vector"] for r in v])
    near = [int(np.argsort(((x - a) ** 2).sum(1))[1]) for a in x]
    assert all(v[i]["cluster"] == v[j]["cluster"] for i, j in enumerate(near))
    with pytest.raises(ValueError):
        synthetic.corpus(spark, 1, kinds=("other",))


def test_hilbert_points_step_by_one(spark):
    n = 16
    d = spark.createDataFrame([(n * i + j, float(i), float(j)) for i in range(n) for j in range(n)], "id long, x double, y double")
    order = [r["id"] for r in content.hilbert_points(d, "id", F.col("x"), F.col("y"), bits=4).orderBy("new_id").collect()]
    assert sorted(order) == list(range(n * n))
    assert all(abs(a // n - b // n) + abs(a % n - b % n) == 1 for a, b in zip(order, order[1:], strict=False))


def test_splits(spark):
    from bytelens.operators.folds import split_fold

    raw = bytes(range(100))
    for split in (lambda n: n // 2, lambda n: n // 3, lambda n: 7, lambda n: 0):
        assert split_fold(raw, sum, lambda a, b: a + b, 0, 10, split) == sum(raw)
    assert split_fold(raw, len, max, 0, 10, lambda n: 0) == 100
