"""Operators on awkward tables: nulls, empty payloads, no rows, other partitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelens.functions import columns as fc
from bytelens.functions import native as fn
from bytelens.functions import payload as pl
from bytelens.operators import content, histograms, neighbours, sketching
from bytelens.sources import files


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(0, None), (1, bytearray(b"")), (2, bytearray(b"a")), (3, bytearray(b"ab" * 300)), (4, bytearray(bytes(range(256)))), (5, bytearray(b"\xff\xfe"))]
    return spark.createDataFrame(rows, "id long, payload binary").repartition(3)


def test_null_in_null_out(payloads):
    x = F.col("payload")
    for f in (fc.byte_counts, fc.run_lengths, fc.byte_classes, fc.byte_moments, fc.structure, fc.entropies, fc.extent_fingerprint, fc.representation_hint, fc.detect_format, fc.validate_utf8, fc.fnv1a64, fc.crc32c_raw, fc.blake3, fc.ctph, fc.quartile_digest, fc.sha256_cid):
        got = {r["id"]: r["v"] for r in payloads.select("id", f(x).alias("v")).collect()}
        assert got[0] is None and (f is fc.quartile_digest or got[1] is not None), f


def test_histogram_does_not_depend_on_partitions(payloads):
    a = histograms.ngram_histogram(payloads, F.col("payload"), 2)
    b = histograms.ngram_histogram(payloads.repartition(1), F.col("payload"), 2)
    assert sorted(a.collect()) == sorted(b.collect())
    assert histograms.ngram_histogram(payloads.where("false"), F.col("payload")).collect() == []


def test_divergences_of_empty_and_unequal(spark):
    d = spark.createDataFrame([([0, 0], [0, 0]), ([1, 1], [0, 0]), ([1, 0], [0, 1]), ([1], [1, 2])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = d.select(fn.total_variation(a, b), fn.kolmogorov_smirnov(a, b), fn.kullback_leibler(a, b), fn.hellinger(a, b), fn.cosine_counts(a, b), fn.cosine_similarity(a, b)).collect()
    assert tuple(got[0]) == (0, 0, 0, 0, 0, 0)
    assert tuple(got[2])[:2] == (1, 1) and got[2][2] == float("inf") and got[2][3] == pytest.approx(1) and got[2][4] == 1
    assert all(x is None for x in got[3])
    assert got[1][4] == 1.0


def test_native_equals_kernels(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(0, 9, 256)
    d = spark.createDataFrame([(c.tolist(),)], "c array<long>")
    x = F.col("c")
    got = d.select(fn.entropy(x), fn.min_entropy(x), fn.renyi(x, 2.0), fn.top_coverage(x, 16), fn.concentration(x)).first()
    want = (pl.entropy(c), pl.min_entropy(c), pl.renyi(c, 2.0), pl.top_coverage(c, 16), pl.concentration(c))
    assert tuple(got) == pytest.approx(want)


def test_sets_and_bits(spark):
    d = spark.createDataFrame([([1, 2, 3], [3, 4]), ([], [])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = d.select(fn.intersect(a, b), fn.union(a, b), fn.difference(a, b), fn.symmetric_difference(a, b), fn.jaccard_sets(a, b), fn.jaccard_bits(a, b), fn.gaps(a)).collect()
    assert tuple(got[0])[:5] == ([3], [1, 2, 3, 4], [1, 2], [1, 2, 4], 0.25) and got[0][6] == [1, 1, 1]
    assert got[1][4] == 0.0 and got[1][5] == 1.0
    v = spark.createDataFrame([([1.0, -1.0] * 40,)], "v array<double>").select(fn.sign_words(F.col("v")).alias("w")).first()["w"]
    assert [x & (2**64 - 1) for x in v] == [0x5555555555555555, 0x5555]


def test_minhash_columns(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, []), (4, None)], "id int, w array<string>")
    rows = {r["id"]: r for r in d.select("id", content.minhash(F.col("w"), 16, 1).alias("m"), content.simhash(F.col("w")).alias("s")).collect()}
    assert rows[1]["m"] == rows[2]["m"] and rows[1]["s"] == rows[2]["s"] and rows[3]["m"] == [None] * 16 and rows[4]["m"] is None
    m = d.where("id <= 2").select("id", content.minhash(F.col("w"), 16, 1).alias("m")).persist()
    p = m.alias("a").join(m.alias("b"), F.col("a.id") < F.col("b.id"))
    got = p.select(content.minhash_jaccard(F.col("a.m"), F.col("b.m")), content.b_bit_jaccard(F.col("a.m"), F.col("b.m"), 3)).first()
    assert tuple(got) == (1.0, 1.0)


def test_nearest_skips_what_cannot_compare(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.where("vec_id = 1")
    assert [r["id"] for r in neighbours.nearest(v, q, 2).orderBy("rank").collect()] == [1, 5]
    assert [r["id"] for r in neighbours.nearest(v, q, 9, "cosine").orderBy("rank").collect()] == [1, 2, 5]
    assert neighbours.nearest(v, q.where("false"), 2).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest(v, q, 2, "chebyshev")


def test_heavy_hitters_bounds(spark):
    d = spark.range(20_000).select((F.col("id") % 7 * F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("x")).repartition(5)
    held = {r["item"]: r for r in sketching.heavy_hitters(d, F.col("x"), 20).collect()}
    for r in d.groupBy("x").count().where("count > 20000 / 21").collect():
        assert held[r["x"]]["low"] <= r["count"] <= held[r["x"]]["high"]


def test_blocks_and_sidecars(spark, tmp_path, payloads):
    b = files.blocks(payloads, size=256).collect()
    assert sorted((r["id"], r["block"], len(r["payload"])) for r in b) == [(2, 0, 1), (3, 0, 256), (3, 1, 256), (3, 2, 88), (4, 0, 256), (5, 0, 2)]
    assert files.blocks(payloads, size=256, tail=False).count() == 3
    rows = [("one", "p", *[0.5] * 6, b"abc"), ("two", "q", *[1.5] * 6, b"")]
    (tmp_path / "x.f22").write_bytes(files.write_sidecar(rows))
    got = [tuple(r) for r in files.extents(spark, str(tmp_path)).collect()]
    assert got == rows
    with pytest.raises(ValueError):
        list(files.read_sidecar(b"nothing here"))


def test_graph_orders(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (5, 4)], "src long, dst long")
    for kind in ("rcm", "community"):
        o = content.graph_order(e, kind)
        assert sorted(r["new_id"] for r in o.collect()) == list(range(23))
    assert content.graph_bandwidth(e, content.graph_order(e)).first()[0] == 1
    with pytest.raises(ValueError):
        content.graph_order(e, most=3)


def test_chunks_join_up(spark, payloads):
    from bytelens.functions.chunking import ChunkSizes

    sizes = ChunkSizes.around(64)
    c = content.chunk_rows(payloads, F.col("payload"), sizes, ["id"])
    q = {r["id"]: r for r in content.chunk_quality(c, sizes, ["id"]).collect()}
    assert q[3]["total_bytes"] == 600 and set(q) == {2, 3, 4, 5}
    assert content.chunk_dedup(c).agg(F.sum("copies")).first()[0] == c.count()


def test_windows_and_periods(spark, payloads):
    from bytelens.functions import windows as w

    x = F.col("payload")
    got = {r["id"]: r for r in payloads.select("id", w.strided(x, 2, 3).alias("s"), w.strided(x, 0, 1).alias("none"), w.repeated_period(x).alias("p"), w.is_zero_page(x).alias("z")).collect()}
    assert got[0]["s"] is None and got[1]["s"] == [] and got[2]["s"] == [] and got[2]["none"] == []
    assert [bytes(b) for b in got[3]["s"]] == [(b"ab" * 300)[i : i + 2] for i in range(0, 599, 3)]
    assert got[3]["p"] == 2 and got[4]["p"] is None and got[2]["p"] is None and not got[4]["z"]
    d = spark.createDataFrame([(bytearray(b"\x01\x02\x03"), ["a", "b", "c"]), (bytearray(b"\0\0\0"), [])], "b binary, l array<string>")
    got = d.select(w.pack_le(F.col("b"), 3), w.word_ngrams(F.col("l"), 2), w.is_zero_page(F.col("b"))).collect()
    assert tuple(got[0]) == (0x030201, ["a b", "b c"], False) and tuple(got[1]) == (0, [], True)


def test_folds(spark, payloads):
    from bytelens.operators import folds

    x = F.col("payload")
    r = folds.min_max_len(payloads.where("id > 0"), x, []).first()
    assert tuple(r) == (0, 255, 1 + 600 + 256 + 2)
    for n in (0, 1, 5, 16, 17, 100, 1000, 1025):
        raw = bytes(n)
        want = folds.split_fold(raw, lambda b: 1, lambda a, b: a + b, 0, 16)
        d = spark.createDataFrame([(bytearray(raw),)], "payload binary")
        assert folds.leaf_count(d, F.col("payload"), 16, []).first()[0] == want, n
    leaf = lambda b: np.bincount(np.frombuffer(b, np.uint8), minlength=256).astype(np.int64).tobytes()
    got = np.frombuffer(folds.fold(payloads.repartition(9), x, leaf, folds.add_histograms, bytes(2048), fan=2), np.int64)
    want = sum((pl.counts(np.frombuffer(bytes(r["payload"]), np.uint8)) for r in payloads.where("payload IS NOT NULL").collect() if r["payload"]), np.zeros(256, np.int64))
    assert (got == want).all()


def test_running_checksums(spark, tmp_path):
    from bytelens.streaming.sequences import running_checksums

    parts = [("a", 1, b"lo "), ("a", 0, b"hel"), ("b", 1, b"late"), ("a", 2, b"you"), ("a", 2, b"again")]
    df = spark.createDataFrame([(k, s, bytearray(p)) for k, s, p in parts], "key string, seq long, payload binary")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_checksums(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("sums").start()
    q.awaitTermination()
    got = {r["key"]: (r["pieces"], r["crc"]) for r in spark.table("sums").collect()}
    assert got == {"a": (3, pl.crc32c(b"hello you")), "b": (0, 0)}
