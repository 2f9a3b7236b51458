"""Automata, digests and chunks of pieces, bit vectors and posting blocks against plain computations."""

from __future__ import annotations

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelens.functions import columns as fc
from bytelens.functions import hashes
from bytelens.functions.automaton import Automaton
from bytelens.functions.chunking import ChunkSizes, OpenChunks, chunks
from bytelens.functions.digests import Blake3, Sha256
from bytelens.functions.search import find_many
from bytelens.operators import bitvectors, neighbours, patterns, postings

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_one_scan_for_each_pattern(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abc\x00", bytes(range(256))])
    text = lambda n: bytes(rng.choice(letters) for _ in range(n))
    known = [text(rng.randrange(1, 7)) for _ in range(40)] + [b"", text(1), text(40)]
    known += known[:3]  # equal patterns are patterns of their own
    payloads = [text(rng.randrange(0, 90)) for _ in range(60)] + [b"", text(9000)]
    at = np.cumsum([0] + [len(p) for p in payloads])
    doc, offset, number = Automaton(known).scan(np.frombuffer(b"".join(payloads), np.uint8), at)
    got = [[] for _ in payloads]
    for d, o, k in zip(doc.tolist(), offset.tolist(), number.tolist(), strict=True):
        got[d].append((o, k))
    assert got == [find_many(known, p) for p in payloads]


def test_automaton_of_nothing():
    for known in ([], [b""]):
        assert all(len(x) == 0 for x in Automaton(known).scan(np.frombuffer(b"abc", np.uint8), np.array([0, 3])))
    assert len(Automaton([b"a"]).scan(np.zeros(0, np.uint8), np.array([0]))[0]) == 0


def test_a_thousand_patterns_take_one_scan():
    import time

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 4_000_000).astype(np.uint8)
    at = np.array([0, len(raw)])
    few, many = (Automaton([bytes(rng.integers(97, 123, 8).astype(np.uint8)) for _ in range(n)]) for n in (1, 1000))
    took = []
    for machine in (few, many):
        start = time.perf_counter()
        machine.scan(raw, at)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5  # one scan for each pattern would take a thousand times as long


def test_pattern_columns(spark):
    rows = [(1, b"she sells"), (2, None), (3, b""), (4, b"hehe")]
    df = spark.createDataFrame(rows, "id long, raw binary")
    got = {r["id"]: r["m"] for r in df.select("id", fc.find_many(F.col("raw"), [b"he", b"she", b"e"]).alias("m")).collect()}
    assert got[2] is None and got[3] == []
    assert [tuple(x) for x in got[1]] == find_many([b"he", b"she", b"e"], b"she sells") and [tuple(x) for x in got[4]] == find_many([b"he", b"she", b"e"], b"hehe")
    named = spark.createDataFrame([(b"he",), (b"zz",), (b"e",), (b"",), (None,), (b"he",)], "pattern binary")
    hits = {bytes(r["pattern"]): (r["n_payloads"], r["hits"]) for r in patterns.pattern_hits(df, F.col("raw"), named).collect()}
    assert hits == {b"he": (2, 3), b"zz": (0, 0), b"e": (2, 4)}
    with pytest.raises(ValueError):
        patterns.pattern_hits(df, F.col("raw"), named, most=1)


@pytest.mark.parametrize("n", [0, 1, 55, 56, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 7169])
def test_digests_of_pieces(n):
    rng = random.Random(n)
    raw = rng.randbytes(n)
    for make, want in ((Sha256, hashlib.sha256(raw).digest()), (Blake3, hashes.blake3(raw))):
        h, i = make(), 0
        assert n or h.digest() == want
        while i < n:
            k = rng.choice([0, 1, 7, 63, 64, 65, 700, 1024])
            h.update(raw[i : i + k])
            i += k
            h = make.load(h.dump())
        assert h.digest() == want == h.digest()
        h.update(b"more")
        assert h.digest() == (hashlib.sha256(raw + b"more").digest() if make is Sha256 else hashes.blake3(raw + b"more"))


@pytest.mark.parametrize("sizes", [ChunkSizes.around(64), ChunkSizes.around(64, 1), ChunkSizes.around(256, 3), ChunkSizes(1, 1, 5), ChunkSizes(30, 64, 64, 1)])
def test_open_chunks_equal_those_of_the_whole(sizes):
    rng = random.Random(3)
    for n in (0, 1, 20, 300, 6000):
        raw = rng.choice([rng.randbytes(n), bytes(n), b"ab" * (n // 2)])
        for most in (1, 9, 400, 10_000):
            now, out, i = OpenChunks(sizes), [], 0
            while i < n:
                k = rng.randrange(0, most + 1)
                out += now.feed(raw[i : i + k])
                i += k
                now = OpenChunks(sizes, now.h, now.read, now.start)
            assert out + now.close() == chunks(raw, sizes)


def test_streams_of_pieces_after_a_restart(spark, tmp_path):
    """Any cutting and order, pieces that come twice, null pieces, and a query that is stopped between two files."""
    from bytelens.streaming.pieces import running_chunks, running_digests

    rng = random.Random(6)
    sizes = ChunkSizes.around(64, 1)
    whole = {k: rng.randbytes(rng.randrange(0, 3000)) for k in range(12)}
    rows = []
    for k, raw in whole.items():
        cut = sorted(rng.randrange(len(raw) + 1) for _ in range(rng.randrange(0, 9)))
        parts = [raw[a:b] for a, b in zip([0, *cut], [*cut, len(raw)], strict=True)]
        rows += [(k, s, p or None, s == len(parts) - 1) for s, p in enumerate(parts)]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    kind = "key int, seq long, payload binary, last boolean"
    third = len(rows) // 3

    def drained(make, name, mode):
        out = []
        for i in range(3):  # each a query of its own that goes on from the checkpoint
            spark.createDataFrame(rows[i * third : (i + 1) * third if i < 2 else None], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
            stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}-in")
            took = lambda batch, _: out.extend(batch.collect())
            make(stream).writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-state").foreachBatch(took).start().awaitTermination()
        return out

    got = drained(lambda s: running_chunks(s, sizes), "chunks", "append")
    assert sorted((r["key"], r["start"], r["end"], r["hash"]) for r in got) == sorted((k, a, b, hashes.signed(h)) for k, raw in whole.items() for a, b, h in chunks(raw, sizes))
    for name, plain in (("sha256", lambda x: hashlib.sha256(x).digest()), ("blake3", hashes.blake3)):
        last = {}
        for r in drained(lambda s, name=name: running_digests(s, name), name, "update"):
            last[r["key"]] = max(last.get(r["key"], (-1,)), (r["pieces"], r["n_bytes"], bytes(r["digest"])))
        assert {k: x[1:] for k, x in last.items()} == {k: (len(raw), plain(raw)) for k, raw in whole.items()}


def test_bit_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {"dense": np.flatnonzero(rng.random(70_000) < 0.6), "sparse": np.sort(rng.choice(40_000_000, 150, replace=False)), "one": np.array([63]), "none": np.zeros(0, int)}
    rows = [(v, int(p), 1) for v, ones in vectors.items() for p in ones] + [("none", 9000, 0), ("one", 4096, 0), ("one", -5, 1), ("one", None, 1), ("dense", int(vectors["dense"][0]), 1)]
    bits = spark.createDataFrame(rows, "v string, pos long, bit int")
    held = bitvectors.directory(bitvectors.packed_words(bits, ["v"]), ["v"]).persist()
    assert held.where("v = 'sparse'").count() == int(vectors["sparse"].max()) // bitvectors.BLOCK + 1
    asked = [(v, int(p)) for v, ones in vectors.items() for p in [0, 1, 63, 64, 4095, 4096, *(ones[:40]), *(ones[:40] + 1)]] + [("dense", 10**9), ("absent", 1), ("one", None)]
    asked = list(dict.fromkeys(asked))
    top = {v: (held.where(F.col("v") == v).agg(F.max("block")).first()[0]) for v in vectors}
    for r in bitvectors.rank_of(spark.createDataFrame(asked, "v string, pos long"), held, ["v"]).collect():
        inside = r["pos"] is not None and r["v"] in vectors and r["pos"] // bitvectors.BLOCK <= top[r["v"]]
        if inside and r["rank1"] is not None:
            assert r["rank1"] == int((vectors[r["v"]] < r["pos"]).sum()), r
        else:
            assert r["rank1"] is None and (not inside or r["pos"] % bitvectors.BLOCK >= 64), r
    marks = bitvectors.samples(held, ["v"])
    assert marks.groupBy("v", "sample").count().agg(F.max("count")).first()[0] <= bitvectors.SAMPLE
    ks = [(v, k) for v, ones in vectors.items() for k in [*range(min(len(ones), 300)), len(ones) - 1, len(ones), -1]]
    ks = list(dict.fromkeys(ks))
    for r in bitvectors.select_of(spark.createDataFrame(ks, "v string, k long"), held, marks, ["v"]).collect():
        ones = vectors[r["v"]]
        assert r["place"] == (int(ones[r["k"]]) if 0 <= r["k"] < len(ones) else None), r


def test_posting_blocks(spark):
    rng = random.Random(4)
    lists = {"every": range(0, 200_000, 3), "low": range(0, 5_000, 7), "high": [2**40 + 5 * i for i in range(500)], "some": sorted(rng.sample(range(200_000), 900)), "one": [21]}
    rows = [(t, i) for t, ids in lists.items() for i in ids] + [("one", 21), (None, 3), ("one", None)]
    index = spark.createDataFrame(rows, "term string, id long")
    blocks = postings.posting_blocks(index).persist()
    assert sorted(map(tuple, postings.ids_of(blocks).collect())) == sorted((t, i) for t, ids in lists.items() for i in ids)
    for terms in (["every", "low"], ["every", "some"], ["low", "one", "every"], ["high", "every"], ["some"], ["none", "one"], []):
        want = set.intersection(*[set(lists.get(t, [])) for t in terms]) if terms else set()
        assert {r["id"] for r in postings.block_all_of(blocks, terms).collect()} == want, terms
    # Blocks out of the other term's reach aren't decoded.
    of = lambda t: blocks.where(F.col("term") == t).count()
    met = {r["term"]: r["count"] for r in postings.blocks_that_meet(blocks, ["every", "low"]).groupBy("term").count().collect()}
    assert met["low"] == of("low") and met["every"] * 20 < of("every")
    assert postings.blocks_that_meet(blocks, ["high", "every"]).count() == 0
    ids = spark.createDataFrame([(i,) for i in range(0, 9000, 5)], "id long")
    assert {r["id"] for r in postings.block_but_not(ids, blocks, ["every", "low"]).collect()} == {i for i in range(0, 9000, 5) if i % 3 and not (i < 5000 and i % 7 == 0)}
    assert sorted(r["id"] for r in neighbours.all_of(index, ["every", "some"]).collect()) == sorted(set(lists["every"]) & set(lists["some"]))


@tables
@pytest.mark.parametrize("name", ["chunk_boundaries", "streamed_chunks", "streamed_digests", "directory_ranks", "directory_selects", "posting_blocks_all_of", "pattern_documents", "container_operations", "container_unions", "piece_run_lengths", "piece_grams"])
def test_queries_equal_their_sql(spark, name):
    from bytelens.plans.registry import ORACLE_SQL, QUERIES
    from bytelens.plans import stores  # noqa: F401

    con = duckdb.connect()
    for t in ("documents", "events", "orders", "lineitem", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    want = sorted(tuple(dict(zip([d[0] for d in cur.description], r, strict=True))[c] for c in names) for r in cur.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names and sorted(tuple(r[c] for c in names) for r in got.collect()) == want


def test_sets_of_rows_that_share_an_id(spark):
    rows = [(5, list("abcdefghij")), (5, list("klmnopqrst")), (1, list("abcdefghijz")), (2, list("klmnopqrstz")), (3, list("abcdefghij")), (4, None), (6, [])]
    got = {(r["a"], r["b"]): round(r["jaccard"], 6) for r in neighbours.set_similarity_join(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w"), 0.8).collect()}
    assert got == {(1, 5): round(10 / 11, 6), (2, 5): round(10 / 11, 6), (1, 3): round(10 / 11, 6), (3, 5): 1.0}
    assert neighbours.set_similarity_join(spark.createDataFrame([], "id long, w array<string>"), "id", F.col("w"), 0.8).count() == 0


def test_simhash_keys_meet_near_signatures_and_few_others(spark):
    rng = random.Random(3)
    plain = [rng.getrandbits(64) for _ in range(20_000)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for x in plain[:300]]
    rows = [(k, hashes.signed(x)) for k, x in enumerate(plain + near)]
    df = spark.createDataFrame(rows, "id long, s long").repartition(8)
    got = {(r["a"], r["b"]) for r in neighbours.simhash_pairs(df, "id", F.col("s")).collect()}
    assert {(k, 20_000 + k) for k in range(300)} <= got
    keys = df.select(F.posexplode(neighbours.simhash_keys(F.col("s"), 3, 6)).alias("band", "key")).groupBy("band", "key").count()
    meet = keys.select(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert meet < len(rows)  # a pair in some thousand of unlike ones, where eight blocks of eight bits made six million


def test_nearest_in_several_passes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one, many = ({(r["query_id"], r["rank"], r["id"]) for r in neighbours.nearest(df, df, 3, most=m).collect()} for m in (1000, 7))
    assert one == many and len(one) == 180


def some_sets(rng):
    dense = np.flatnonzero(rng.random(200_000) < 0.5)
    return [np.zeros(0, int), np.array([0]), np.array([65535, 65536]), np.arange(70_000), dense, np.sort(rng.choice(1 << 32, 9000, replace=False)), np.arange(0, 1 << 18, 3), np.r_[np.arange(100), np.arange(5000, 5400), [(1 << 32) - 1]], dense[::7], np.arange(0, 65536, 16), np.arange(0, 65536 - 16, 16)]


def test_container_algebra():
    from bytelens.functions import containers as ct

    sets = some_sets(np.random.default_rng(3))
    packed = [ct.pack(s) for s in sets]
    plain = {"and": np.intersect1d, "or": np.union1d, "minus": np.setdiff1d, "xor": np.setxor1d}
    for s, raw in zip(sets, packed, strict=True):
        assert (ct.unpack(raw) == s).all() and ct.cardinality(raw) == len(s) and ct.problem(raw) is None
        for x in [0, 1, 65535, 65536, 5399, 5400, (1 << 32) - 1, *s[:3].tolist()]:
            assert ct.contains(raw, int(x)) == bool((s == x).any())
    for (s, a), (t, b) in ((x, y) for x in zip(sets, packed, strict=True) for y in zip(sets, packed, strict=True)):
        for op, f in plain.items():
            got = ct.merge(op, a, b)
            assert got == ct.pack(f(s, t)) and ct.problem(got) is None  # one form for each set
    assert ct.union(packed) == ct.pack(np.unique(np.concatenate(sets))) and ct.union([]) == ct.pack(np.zeros(0, int))
    kinds = {kind for raw in packed for _, kind, _, _ in ct._read(raw)}
    assert kinds == {ct.ARRAY, ct.BITMAP, ct.RUNS}
    # Broken forms are seen.
    raw = ct.pack(np.array([1, 5, 9, 70_000]))
    swapped = bytearray(raw)
    swapped[-8:-6], swapped[-6:-4] = raw[-6:-4], raw[-8:-6]
    for bad in (b"", b"xx" + raw[2:], raw[:-1], raw + b"\0", raw[:10], bytes(swapped), raw[:6] + raw[6 + ct._HEAD.itemsize : 6 + 2 * ct._HEAD.itemsize] + raw[6 : 6 + ct._HEAD.itemsize] + raw[6 + 2 * ct._HEAD.itemsize :]):
        assert ct.problem(bad) is not None


def test_container_columns_and_unions(spark):
    from bytelens.operators.sets import union_sets

    rows = [(1, [5, 1, None, -3, 1 << 40], [5]), (2, [], [7]), (3, None, [1]), (4, list(range(100)), list(range(50, 150)))]
    d = spark.createDataFrame(rows, "id int, a array<long>, b array<long>").withColumn("x", fc.container_set(F.col("a"))).withColumn("y", fc.container_set(F.col("b")))
    for op, f in (("and", lambda p, q: p & q), ("or", lambda p, q: p | q), ("minus", lambda p, q: p - q), ("xor", lambda p, q: p ^ q)):
        got = {r["id"]: r["m"] for r in d.select("id", fc.container_members(fc.container_merge(op, F.col("x"), F.col("y"))).alias("m")).collect()}
        assert got == {i: None if a is None else sorted(f({v for v in a if v is not None and 0 <= v < 1 << 32}, set(b))) for i, a, b in rows}
    assert [r[0] for r in d.orderBy("id").select(fc.container_has(F.col("x"), 5)).collect()] == [True, False, None, True]
    assert [r[0] for r in d.select(fc.container_problem(F.col("x")).alias("p")).where("p IS NOT NULL").collect()] == []
    many = [(k % 5, [k, 3 * k, 70_000 + k]) for k in range(400)] + [(9, None)]
    e = spark.createDataFrame(many, "g int, v array<long>").repartition(6).select("g", fc.container_set(F.col("v")).alias("s"))
    for most in (1, 10_000):
        got = {r["g"]: r["m"] for r in union_sets(e, ["g"], "s", most=most).select("g", fc.container_members(F.col("s")).alias("m")).collect()}
        assert got == {g: sorted({x for h, v in many if h == g and v for x in v}) for g in range(5)}


@pytest.mark.parametrize("most,fan", [(1, 2), (3, 4), (50, 3), (400, 256)])
def test_pieces_equal_the_whole(spark, most, fan):
    from collections import Counter

    from bytelens.functions import payload as pl
    from bytelens.operators import histograms, segments

    rng = random.Random(most)
    whole = {k: bytes(rng.choice(b"aab") for _ in range(rng.randrange(0, 12 * most))) for k in range(8)} | {8: b"", 9: b"a" * (20 * most), 10: b"ab" * most}
    rows = []
    for k, raw in whole.items():
        s = i = 0
        while i < len(raw) or s == 0:
            n = rng.randrange(0, most + 1)
            rows.append((k, s, raw[i : i + n] or None))
            i, s = i + n, s + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, seq long, payload binary")
    got = {r["key"]: tuple(r)[1:] for r in segments.piece_runs(df, fan=fan).collect()}
    assert got == {k: pl.runs(np.frombuffer(raw, np.uint8)) for k, raw in whole.items()}
    for n in (1, 2, 4):
        h = histograms.ngram_histogram(segments.with_context(df, n), F.col("payload"), n, ["key"])
        want = Counter((k, int.from_bytes(raw[i : i + n], "little")) for k, raw in whole.items() for i in range(len(raw) - n + 1))
        assert {(r["key"], r["gram"]): r["cnt"] for r in h.collect()} == want


def test_keyed_filters_and_small_columns(spark):
    from bytelens.functions import native as fn
    from bytelens.functions import payload as pl
    from bytelens.functions.hashes import mix_word
    from bytelens.functions.sketches import BLOOM_SEEDS, Bloom
    from bytelens.operators import sketching

    keys = [0, 1, -1, 2**62, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").repartition(5)
    bloom = sketching.bloom_filter(df, F.col("k"), 400, 0.01)
    plain = Bloom.sized(400, 0.01)
    for k in keys:
        u = k % (1 << 64)
        a, b = mix_word(u ^ BLOOM_SEEDS[0]), mix_word(u ^ BLOOM_SEEDS[1]) | 1
        for i in range(plain.hashes):
            p = (a + i * b) % (1 << 64) % plain.bits
            plain.words[p // 64] |= np.uint64(1 << p % 64)
    assert (bloom.words == plain.words).all() and bloom.n == len(keys)
    asked = spark.createDataFrame([(k,) for k in [*keys, *range(10**6, 10**6 + 2000)]] + [(None,)], "k long")
    got = {r["k"]: r["m"] for r in asked.select("k", sketching.bloom_contains_key(F.col("k"), bloom).alias("m")).collect()}
    assert got[None] is None and all(got[k] for k in keys) and sum(got[k] for k in range(10**6, 10**6 + 2000)) < 60
    rate = spark.range(1).select(fn.bloom_rate(F.lit(len(keys)), bloom.bits, bloom.hashes), fn.bloom_rate(F.lit(0), 64, 3)).first()
    assert rate[0] == pytest.approx(bloom.rate()) and rate[1] == 0
    gaps = spark.createDataFrame([([5, 0, 3, -2],), ([],), (None,)], "g array<long>")
    assert [r[0] for r in gaps.select(fn.undelta(F.col("g"))).collect()] == [[5, 5, 8, 6], [], None]
    raw = random.Random(1).randbytes(3000) + b"ab" * 400
    counts = np.bincount(np.frombuffer(raw[:-1], np.uint8) + 256 * np.frombuffer(raw[1:], np.uint8).astype(int), minlength=65536).tolist()
    one = spark.createDataFrame([(counts,)], "c array<long>").select(fn.conditional_entropy(F.col("c"))).first()[0]
    assert one == pytest.approx(pl.conditional_entropy(np.frombuffer(raw, np.uint8)))
