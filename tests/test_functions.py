"""Functions of one payload against known values and plain computations."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from bytelens.functions import chunking, codecs, formats, hashes, hnsw, orders, payload, search, similar, sketches

arr = lambda b: np.frombuffer(bytes(b), np.uint8)
RNG = random.Random(1)
PAYLOADS = [b"", b"a", b"abc", bytes(range(256)) * 16, b"\x2a" * 4096, b"abababab", b"abababa", b"\0" * 4096, b"\xff" * 255, b"\xe9\xff\xc3", bytes(RNG.randrange(256) for _ in range(70_000)), "héllo wörld ".encode() * 40]


def plain_entropy(items):
    c = {}
    for x in items:
        c[x] = c.get(x, 0) + 1
    n = sum(c.values())
    return -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0


@pytest.mark.parametrize("raw", PAYLOADS[:10] + [PAYLOADS[11]])
def test_entropies(raw):
    b = arr(raw)
    assert payload.entropy(payload.counts(b)) == pytest.approx(plain_entropy(raw), abs=1e-9)
    pairs = list(zip(raw, raw[1:], strict=False))
    assert payload.joint_entropy(b) == pytest.approx(plain_entropy(pairs), abs=1e-9)
    assert payload.conditional_entropy(b) == pytest.approx(max(0, plain_entropy(pairs) - plain_entropy(raw[:-1])), abs=1e-9)
    for n in (2, 3, 8):
        assert payload.ngram_entropy(b, n) == pytest.approx(plain_entropy([raw[i : i + n] for i in range(len(raw) - n + 1)]), abs=1e-9)


def test_known_entropies():
    assert payload.entropy(payload.counts(arr(bytes(range(256)) * 16))) == pytest.approx(8)
    assert payload.min_entropy(payload.counts(arr(b"aab"))) == pytest.approx(-math.log2(2 / 3))
    assert payload.renyi(payload.counts(arr(b"")), 1.0) == 0.0
    assert payload.renyi(payload.counts(arr(b"ab")), 1.0) is None and payload.renyi(payload.counts(arr(b"ab")), -1) is None
    assert payload.renyi(payload.counts(arr(b"aabb")), 2) == pytest.approx(1)


@pytest.mark.parametrize("raw", PAYLOADS)
def test_runs_and_classes(raw):
    lengths, last = [], None
    for x in raw:
        if x == last:
            lengths[-1] += 1
        else:
            lengths.append(1)
        last = x
    want = (len(raw), max(0, len(lengths) - 1), max(lengths, default=0), sum(n >= 4 for n in lengths), sum(n for n in lengths if n >= 4))
    assert payload.runs(arr(raw)) == want
    assert sum(payload.classes(arr(raw))) == len(raw)
    assert payload.crc32c(raw[:50]) == int(_crc_bits(raw[:50]))


def _crc_bits(raw, c=0):
    for x in raw:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c


def test_structure_and_period():
    assert payload.period(arr(b"abababab")) == 2 and payload.period(arr(b"abababa")) is None and payload.period(arr(b"aaaa")) == 1 and payload.period(arr(b"a")) is None
    assert payload.zero_pages(arr(b"\0" * 8192 + b"x")) == 2
    assert payload.utf8("é".encode()[:1]) == (False, 0, 0) and payload.utf8(b"ab\xff") == (False, 2, 1) and payload.utf8(b"") == (True, 0, 0)
    assert payload.moments(arr(b"\x07")) == (1, 7.0, 0.0, 0.0, 0.0)
    n, mean, var, skew, kurt = payload.moments(arr(range(256)))
    assert (n, mean) == (256, 127.5) and var == pytest.approx(5482.67, abs=0.01) and skew == pytest.approx(0, abs=1e-9) and kurt == pytest.approx(-1.2, abs=0.01)


def test_fingerprints():
    assert payload.extent_fingerprint(arr(b"")) == (0.0,) * 5
    zeros = payload.block_fingerprint(arr(b"\0" * 256))
    assert zeros == (0, 0, 1, 255, 1 << 2)
    flat = payload.block_fingerprint(arr(range(256)))
    assert flat[0] == flat[1] == 128 and flat[2] == 0 and flat[3] == 4 and flat[4] == 1 << 3
    big = arr(PAYLOADS[10])
    assert payload.extent_fingerprint(big)[1] == payload.extent_fingerprint(big)[0]  # random: the shortcut
    text = arr(b"the quick brown fox jumps over the lazy dog " * 2000)
    assert payload.extent_fingerprint(text) != payload.extent_fingerprint(text, exact=True)
    assert [payload.hint(arr(x)) for x in (b"", b"\0" * 100, b"some text", b"\x80\x81" * 64, PAYLOADS[10])] == ["empty", "sparse", "text", "low_cardinality", "high_entropy"]


def test_formats():
    want = {b"\x1f\x8b..": "Gzip", b"RIFF....WAVE": "Wav", b"RIFF....XXXX": "AsciiText", b"....ftypavif": "Avif", b"....ftypisom": "Mp4", b" \n{": "Json", b"<a>": "Xml", "é".encode(): "Utf8Text", b"abc": "AsciiText", b"\x01": "Unknown", b"": "Unknown", b"MZ": "Pe", b"x" * 257 + b"ustar": "Tar", PAYLOADS[10]: "HighEntropy"}
    for raw, name in want.items():
        assert formats.detect(raw)[0] == name
    assert set(formats.FORMATS) >= {n for _, _, n in formats.SIGNATURES if n not in ("RIFF", "ftyp")}


def test_hashes():
    assert hashes.mix_word(0) == 0xE220A8397B1DCDAF
    assert int(hashes.mix_words(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    assert hashes.fnv1a64(b"") == 0xCBF29CE484222325 and hashes.fnv1a64(b"hello") == 0xA430D84680AABD0B
    for v in (0, 127, 128, 300, 2**64 - 1):
        assert hashes.unvarint(hashes.varint(v)) == (v, len(hashes.varint(v)))
    assert hashes.unvarint(b"\x80") is None and hashes.unvarint(b"\xff" * 10) is None
    m = hashes.multihash(hashlib.sha256(b"x").digest())
    assert hashes.unmultihash(m) == ("sha2-256", hashlib.sha256(b"x").digest()) and hashes.unmultihash(m[:-1]) is None
    assert hashes.sha256_cid(b"hello").startswith("bafkrei")
    assert hashes.base32(b"foobar") == "mzxw6ytboi"
    # Published values of BLAKE3 for the empty input and for 1,025 counted bytes.
    assert hashes.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashes.blake3(bytes(i % 251 for i in range(1025))).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert hashes.blake3(b"abc", 70)[:32] == hashes.blake3(b"abc")


def test_sketches():
    rng = np.random.default_rng(2)
    items = (rng.zipf(1.4, 20_000) % 5000).astype(np.int64)
    true = np.bincount(items)
    mg, ss = sketches.MisraGries(50), sketches.SpaceSaving(50)
    for x in items.tolist():
        mg.update(x), ss.update(x)
    for x in range(30):
        assert true[x] - mg.error <= mg.counts.get(x, 0) <= true[x]
    assert all(c >= true[x] for x, c in ss.snapshot()) and sum(c for _, c in ss.snapshot()) == len(items)
    a, b = sketches.MisraGries(50), sketches.MisraGries(50)
    for k, x in enumerate(items.tolist()):
        (a if k % 3 else b).update(x)
    a.merge(b)
    assert len(a.counts) <= 50 and all(true[x] - a.error <= a.counts.get(x, 0) <= true[x] for x in range(30))
    cm = sketches.CountMin(4, 1024)
    cm.update(items)
    est = cm.estimate(np.arange(5000))
    assert (est >= np.bincount(items, minlength=5000)[:5000]).all()
    h = sketches.HyperLogLog(12)
    for i in range(20_000):
        h.insert(struct.pack("<q", i))
    assert h.estimate() == pytest.approx(20_000, rel=0.06)
    assert sketches.hll_index_rank(0, 4) == (0, 61) and sketches.hll_index_rank(1 << 59, 4) == (0, 1)
    bl = sketches.Bloom.sized(1000, 0.01)
    for i in range(1000):
        bl.insert(str(i).encode())
    assert all(bl.contains(str(i).encode()) for i in range(1000)) and sum(bl.contains(f"x{i}".encode()) for i in range(5000)) < 150
    p = sketches.P2Quantile(0.5).update_all(rng.normal(size=5000))
    assert abs(p.estimate()) < 0.1 and math.isnan(sketches.P2Quantile(0.5).estimate())
    assert sketches.P2Quantile(0.5).update_all([3.0, math.nan, 1.0, 2.0]).estimate() == pytest.approx(2.0, abs=1)


def test_minhash_and_simhash():
    a, b = np.arange(200, dtype=np.uint64), np.arange(100, 300, dtype=np.uint64)
    x, y = (similar.minhash(hashes.mix_words(v), 256, 9) for v in (a, b))
    assert similar.jaccard(x, y) == pytest.approx(1 / 3, abs=0.1)
    assert similar.b_bit_jaccard((similar.b_bit(x[0], 2), x[1]), (similar.b_bit(y[0], 2), y[1]), 2) == pytest.approx(1 / 3, abs=0.15)
    assert similar.jaccard(similar.minhash(a[:0], 8, 1), similar.minhash(a[:0], 8, 1)) == 0.0
    s, there = similar.one_permutation(a[:5], 16, 3)
    d, full = similar.densify(s, there)
    assert full.all() and all(d[i] == s[next(j % 16 for j in range(i, i + 16) if there[j % 16])] for i in range(16))
    h = hashes.mix_words(a)
    want = sum(1 << bit for bit in range(64) if sum(1 if int(v) >> bit & 1 else -1 for v in h) > 0)
    assert similar.simhash(h) == want and similar.hamming(0, 7) == 3 and similar.simhash_cosine(5, 5) == 1
    assert len(similar.simhash_bands(2**64 - 1, 5)) == 5 and similar.simhash_bands(0xFFFF, 4)[0] == 0xFFFF
    seeds = np.arange(64, dtype=np.uint64)
    assert similar.simhash_bytes(arr(b"abc"), seeds) == similar.simhash_bytes(arr(b"cab"), seeds)


def plain_ctph(raw, size):
    """One pass with the rolling hash kept step by step."""
    win, h1, h2, h3, out, fnv = [0] * 7, 0, 0, 0, "", 0x811C9DC5
    for i, x in enumerate(raw):
        h2 = (h2 + 7 * x - h1) & 0xFFFFFFFF
        h1 = (h1 + x - win[i % 7]) & 0xFFFFFFFF
        win[i % 7] = x
        h3 = (h3 << 5 ^ x) & 0xFFFFFFFF
        fnv = (fnv ^ x) * 0x01000193 & 0xFFFFFFFF
        if ((h1 + h2 + h3 & 0xFFFFFFFF) + 1) % size == 0:
            out, fnv = out + similar.B64[fnv & 63], 0x811C9DC5
    return out, similar.B64[fnv & 63]


def test_fuzzy_digests():
    raw = PAYLOADS[10][:9000]
    size, body, _ = similar.ctph(raw)
    full, tail = plain_ctph(raw, size)
    assert len(full) < 64 and body == (full + tail)[:64]
    assert size == 3 * 64 or len(plain_ctph(raw, size // 2)[0]) >= 64 or size // 2 * 64 < len(raw)
    near = raw[:4000] + b"!!" + raw[4000:]
    assert similar.ctph_similarity(similar.ctph(raw), similar.ctph(raw)) == 100 or size > 192
    assert similar.ctph_similarity(similar.ctph(raw), similar.ctph(near)) > similar.ctph_similarity(similar.ctph(raw), similar.ctph(PAYLOADS[10][20000:29000]))
    d, e, f = similar.quartile_digest(raw), similar.quartile_digest(near), similar.quartile_digest(b"hello world " * 100)
    assert len(d) == 35 and similar.quartile_digest(b"short") is None
    assert similar.quartile_distance(d, d) == 0 and similar.quartile_distance(d, e) < similar.quartile_distance(d, f)
    assert similar.quartile_distance(d, None) == 0xFFFFFFFF and 0 <= similar.relatedness(similar.ctph(raw), similar.ctph(near), d, e) <= 1


@pytest.mark.parametrize("level", [0, 1, 2])
def test_chunks(level):
    raw = bytes(((i * 131) ^ (i >> 3)) & 255 for i in range(60_000)) + PAYLOADS[10]
    sizes = chunking.ChunkSizes(1024, 4096, 16384, level)
    c = chunking.chunks(raw, sizes)
    assert c[0][0] == 0 and c[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(c, c[1:], strict=False))
    assert all(sizes.min_size < b - a <= sizes.max_size for a, b, _ in c[:-1])
    assert c[-1][2] == chunking.gear_hash(raw) and chunking.chunks(b"", sizes) == []
    strict, loose = sizes.masks()
    for a, b, h in c[:-1]:
        assert b - a == sizes.max_size or not h & (strict if level and b - a <= sizes.avg_size else loose)
    with pytest.raises(ValueError):
        chunking.ChunkSizes(10, 5, 20)


def test_codecs():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 2**32, 1001, dtype=np.uint64)
    for w in (1, 7, 13, 32):
        assert (codecs.bit_unpack(codecs.bit_pack(v, w), w, len(v)) == v & np.uint64((1 << w) - 1)).all()
    v = np.r_[v[:100], [0, 255, 256, 65535, 65536, 2**24 - 1, 2**24]].astype(np.uint32)
    control, data = codecs.stream_vbyte(v)
    assert (codecs.stream_vbyte_decode(control, data, len(v)) == v).all() and len(control) == -(-len(v) // 4)
    with pytest.raises(ValueError):
        codecs.stream_vbyte_decode(control, data[:-1], len(v))
    a, b = (codecs.Container.of(rng.integers(0, 65536, n)) for n in (3000, 9000))
    x, y = set(a.values.tolist()), set(b.values.tolist())
    for got, want in ((a & b, x & y), (a | b, x | y), (a - b, x - y), (a ^ b, x ^ y)):
        assert set(got.values.tolist()) == want and got.kind == ("array" if len(want) <= 4096 else "bitmap")
    assert codecs.popcount(b.words()) == len(b) and codecs.Container.of(np.array([1, 2, 3, 9])).runs() == [(1, 2), (9, 0)]
    assert codecs.Container.checked(np.array([2, 1])) is None and codecs.Container.checked(np.array([70000])) is None
    bits = rng.integers(0, 2, 500)
    r = codecs.RankSelect(bits)
    assert all(r.rank1(i) == bits[:i].sum() and r.rank0(i) == i - bits[:i].sum() for i in (0, 1, 250, 500)) and r.rank1(501) is None
    assert all(bits[r.select1(k)] and r.rank1(r.select1(k)) == k for k in range(0, bits.sum(), 37)) and r.select1(500) is None


def test_search():
    text = b"abababa the cat"
    assert search.find_all(b"aba", text) == [0, 2, 4] and search.find(b"", text) == 0 and search.find(b"zz", text) is None
    assert search.find(b"a" * 17, b"a" * 20, "bitap16") is None and search.find(b"a" * 17, b"a" * 20, "shift_or") == 0
    assert search.find_many([b"ab", b"aba", b"cat"], text)[:3] == [(0, 0), (0, 1), (2, 0)]


def test_orders():
    side = 8
    grid = np.array([[x, y] for x in range(side) for y in range(side)], np.uint32)
    path = [grid[i] for i in sorted(range(len(grid)), key=lambda i: orders.hilbert_keys(grid, 3)[i])]
    assert all(np.abs(a.astype(int) - b.astype(int)).sum() == 1 for a, b in zip(path, path[1:], strict=False))
    q = orders.quantize(np.array([[0.0, 5], [1, 5], [np.nan, 5]]), np.array([0.0, 5]), np.array([1.0, 5]))
    assert q.tolist() == [[0, 0], [65535, 0], [0, 0]]
    n = 30
    perm = list(range(n))
    random.Random(3).shuffle(perm)
    edges = [(perm[i], perm[i + 1]) for i in range(n - 1)]
    visit = orders.rcm(n, edges)
    assert sorted(visit) == list(range(n)) and orders.bandwidth(edges, orders.inverse(visit)) == 1
    two = [(a, b) for g in (0, 10) for a in range(g, g + 10) for b in range(a + 1, g + 10)] + [(0, 10)]
    place = orders.communities(21, two)
    assert sorted(place) == list(range(21)) and max(place[:10]) - min(place[:10]) == 9
    assert orders.modularity_gain(2, 3, 4, 10) == 8


def test_graph_files():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, 1)
    links = [[near[i, 1:9].tolist() + [(i + 97) % 200]] + ([[(i + 20) % 200]] if i % 20 == 0 else []) for i in range(200)]
    raw = hnsw.write(list(range(1000, 1200)), x, links, 0, connectivity=8)
    g = hnsw.read(raw)
    assert g.top == 1 and g.metric == "l2_squared" and g.scalar == "f32"
    hits = sum(len({k for k, _ in hnsw.search(g, x[i].tobytes(), 5, 60)} & set((near[i, :5] + 1000).tolist())) for i in range(50))
    assert hits / 250 > 0.9
    only = hnsw.search(g, x[3].tobytes(), 3, 200, permits={5, 6, 7})
    assert {k for k, _ in only} <= {1005, 1006, 1007}
    for bad in (raw[:50], raw.replace(b"usearch", b"usearcx"), b""):
        with pytest.raises(hnsw.GraphError):
            hnsw.read(bad)
    with pytest.raises(hnsw.GraphError):
        hnsw.search(g, b"abc", 1)
    with pytest.raises(hnsw.GraphError):
        hnsw.search(g, x[0].tobytes(), 0)


def test_crc_of_words():
    w = np.array([0, 1, 0x01020304, 2**32 - 1], np.uint32)
    assert payload.crc32c_words(w).tolist() == [payload.crc32c(int(v).to_bytes(4, "little")) for v in w]
    assert zlib.crc32(b"123456789") != payload.crc32c(b"123456789")
