"""What showed on larger tables only, on fixtures small enough to hold it."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from bytelens.functions import payload
from bytelens.scratch import Scratch


def test_block_entropy_near_a_border():
    """16 x 6.65625 - 0.5 is a border: cut to 32 bits, this block's second entropy stood on it."""
    text = b"! ENEAAT!! BLE.\nERERIN!! THINGSTST!! ONREST,!! THORHE!! THRERE!! ONEDTH!! STEAHE!! BE,!! THTIEA!! THBLE,!! OUER!! ERTIONBLE!! ANHEWH,!! HANT,!! ERND!! OF,!! OREROU!! ON!! THORAT!! THSHHE!! REAT!! HE!! THLYNTOR!! ES!! RE!! OF!! OF!! ATAN!! THAT!! ENEAAT!! B"
    assert len(text) == 256
    grams = [payload.crc32c(text[i : i + 4]) % 256 for i in range(253)]
    n = np.unique(grams, return_counts=True)[1]
    bits = math.log2(253) - math.fsum(int(k) * math.log2(k) for k in n) / 253
    assert payload.block_fingerprint(np.frombuffer(text, np.uint8))[1] == math.floor(bits * 16 + 0.5) == 106


class Watched(Scratch):
    """Notes the plans of what it writes."""

    def __init__(self, spark):
        super().__init__(spark)
        self.plans, self.written = [], []

    def save(self, df):
        self.plans.append(plan_of(df))
        self.written.append(super().save(df))
        return self.written[-1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_keys_of_stars_are_no_broadcast(spark):
    """The keys' size is taken for that of their nodes, here less than that of the table of counts."""
    from bytelens.llm.blocks import stars

    nodes = Scratch(spark).save(spark.range(200).select(F.col("id").alias("node")))
    first = F.floor(F.col("node") / 2) * 200
    watched = Watched(spark)
    met = stars(nodes.select("node", F.explode(F.sequence(first, first + 199)).alias("x")).select("node", F.xxhash64("x").alias("key")), watched)
    assert {(r["a"], r["b"]) for r in met.collect()} == {(k, k + 1) for k in range(0, 200, 2)}
    sent = [p[at.start() :].split("\n") for p in watched.plans for at in re.finditer("BroadcastExchange", p)]
    assert not any("Generate" in line for lines in sent for line in lines[:4])


def test_exploded_keys_of_bands_are_no_broadcast(spark):
    from bytelens.operators import neighbours

    df = Scratch(spark).save(spark.range(64).select("id", F.xxhash64("id").alias("s"), F.array(F.col("id") % 8).alias("keys")))
    assert re.search(r"SortMergeJoin \[band", plan_of(neighbours.simhash_pairs(df, "id", F.col("s"))))
    assert re.search(r"SortMergeJoin \[band", plan_of(neighbours.band_candidates(df, "id", F.col("keys"))))


def test_simhash_of_many_rows(spark):
    """In batches; a null item has no vote, a null set no signature."""
    from bytelens.functions import columns as fc
    from bytelens.functions import hashes, similar

    rows = [(k, [f"w{k * i % 31}é" if i % 5 else None for i in range(k % 40)] if k % 7 else None) for k in range(300)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k long, x array<string>").select("k", fc.simhash_items(F.col("x")).alias("s")).collect()}
    for k, x in rows:
        h = np.array([hashes.mix64(w.encode(), 0) for w in x or [] if w is not None], np.uint64)
        assert got[k] == (None if x is None else hashes.signed(similar.simhash(h)))


def test_containers_of_any_kind_at_once():
    """Sets of arrays, runs, bitmaps and of all of them, against sets of numbers; the forms are those of one container at a time."""
    from bytelens.functions import containers as c

    r = np.random.default_rng(4)
    far, near = r.integers(0, 1 << 32, 900), r.integers(0, 1 << 17, 700)
    thick, runs = r.choice(1 << 16, 20_000, replace=False) + (5 << 16), np.concatenate([np.arange(k, k + 50) for k in range(0, 1 << 20, 9_000)])
    every = [np.zeros(0, np.int64), far, near, thick, runs, np.concatenate([far, thick, runs]), np.concatenate([near, runs + 25, far[:400]]), np.array([0, (1 << 32) - 1])]
    one_by_one = lambda v: c._write([(int(h), c._fit(c.ARRAY, (v[v >> 16 == h] & 0xFFFF).astype("<u2"))) for h in np.unique(v >> 16)])
    for x in every:
        v = np.unique(x)
        assert c.pack(x) == one_by_one(v) and c.unpack(c.pack(x)).tolist() == v.tolist() and c.cardinality(c.pack(x)) == len(v)
        for y in every:
            p, q = set(x.tolist()), set(y.tolist())
            for op, want in zip(("and", "or", "minus", "xor"), (p & q, p | q, p - q, p ^ q), strict=True):
                got = c.merge(op, c.pack(x), c.pack(y))
                assert c.unpack(got).tolist() == sorted(want) and c.problem(got) is None and c.cardinality(got) == len(want)


def test_far_numbers_cost_no_step_for_each_container(monkeypatch):
    from bytelens.functions import containers as c

    steps = []
    monkeypatch.setattr(c, "_fit", lambda *a, f=c._fit: steps.append(a) or f(*a))
    monkeypatch.setattr(c, "_both", lambda *a, f=c._both: steps.append(a) or f(*a))
    x, y = (c.pack(np.arange(k, 1 << 30, 1 << 17)) for k in (0, 1 << 16))
    for op in ("and", "or", "minus", "xor"):
        assert c.problem(c.merge(op, x, y)) is None
    assert not steps


def test_grams_of_pieces_are_not_shuffled_one_by_one(spark):
    import __spark_entry__

    plan = plan_of(__spark_entry__.queries()["piece_grams"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(key" in plan and not re.search(r"hashpartitioning\([^)]*gram", plan)


def test_grams_of_short_and_long_payloads(spark):
    """Cut anywhere, in any order; a null key is a key, null pieces are empty, short payloads have no grams."""
    from collections import Counter

    from bytelens.operators.segments import piece_ngrams

    r = np.random.default_rng(6)
    raw = {k: bytes(r.integers(97, 101, int(n), np.uint8)) for k, n in zip([None, *range(40)], r.choice([0, 2, 4, 5, 300, 900, 1001, 5000], 41), strict=True)}
    rows = [(k, i // 7, x[i : i + 7]) for k, x in raw.items() for i in range(0, len(x), 7)] + [(3, 10_000, None), (50, 0, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(k, int(s), x) for k, s, x in rows], "key long, seq long, payload binary").repartition(5)
    for whole in (0, 1000, 1 << 30):
        got = {x["key"]: tuple(x)[1:] for x in piece_ngrams(df, 4, whole=whole).collect()}
        grams = {k: Counter(x[i : i + 4] for i in range(len(x) - 3)) for k, x in raw.items()}
        assert got == {k: (len(g), g.total(), max(g.values())) for k, g in grams.items() if g}


def test_similar_sets_in_blocks(spark, monkeypatch):
    """Groups of near sets larger than a block, copies, repeated ids, null and empty sets; against all pairs."""
    from bytelens.operators import content, neighbours

    monkeypatch.setattr(neighbours, "BLOCK_ELEMENTS", 60)
    r = np.random.default_rng(8)
    rows: list[tuple] = [(0, None), (1, [])]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(int(r.integers(1, 40)))]
        rows += [(len(rows) + k, [w for w in base if r.random() > 0.06] or base[:1]) for k in range(25)]
    rows += [(k + 1000, x) for k, x in rows[5:60:5]] + [(7, ["a", "b", "c"]), (7, ["a", "b", "c", "d", "e"]), (8, ["a", "b", "c", "d", None])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    want = sorted((a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)) for a, x in rows for b, y in rows if a < b and x and y and 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y)))
    assert len(want) > 300
    got = neighbours.set_similarity_join(df, "id", F.col("w"), 0.8).collect()
    assert sorted((x["a"], x["b"], round(x["jaccard"], 9)) for x in got) == want
    bands = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: i.cast("long"))  # all are candidates
    got = neighbours.set_similarity_join(df, "id", F.col("w"), 0.8, bands=bands).collect()
    assert sorted((x["a"], x["b"], round(x["jaccard"], 9)) for x in got) == want
    got = neighbours.set_similarity_join(df.where("size(array_compact(w)) = size(w)"), "id", F.col("w"), 0.8, bands=content.minhash_bands(content.minhash(F.col("w"), 128, 11), 32)).collect()
    assert {(x["a"], x["b"]) for x in got} == {x[:2] for x in want} - {x[:2] for x in want if 8 in x[:2]} | {(x["a"], x["b"]) for x in got if 8 in (x["a"], x["b"])}


def test_a_set_is_dealt_once_for_all_its_pairs(spark):
    from bytelens.operators import neighbours

    scratch = Watched(spark)
    sets = scratch.save(spark.range(50).select(F.col("id").alias("uid"), F.lit(30).cast("long").alias("n"), F.sequence(F.col("id"), F.col("id") + 29).alias("o")))
    pairs = scratch.save(spark.range(50).select(F.col("id").alias("a")).join(spark.range(50).select(F.col("id").alias("b"))).where("a < b"))
    found = neighbours.overlaps(sets, pairs, scratch)
    assert {(x["a"], x["b"], x["na"], x["nb"], x["both"]) for x in found.collect()} == {(a, b, 30, 30, max(0, 30 - b + a)) for a in range(50) for b in range(a + 1, 50)}
    asked = [x for x in scratch.written if x.columns == ["grp", "i", "j", "uid"]]
    assert [x.count() for x in asked] == [50]


def test_large_graphs_are_ordered_in_rounds(spark):
    """Several components, self loops, repeated edges and a path: the order by levels is that of the sequence."""
    from bytelens.functions import orders
    from bytelens.operators import content

    r = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in zip(r.integers(0, 30, 45), r.integers(100, 140, 45), strict=True)] + [(200 + i, 201 + i) for i in range(5)] + [(300, 300), (200, 200), (7, 5)]
    df = spark.createDataFrame(e, "src long, dst long")
    names = sorted({x for p in e for x in p})
    at = {x: i for i, x in enumerate(names)}
    want = orders.inverse(orders.rcm(len(names), [(at[a], at[b]) for a, b in e]))
    got = {x["id"]: x["new_id"] for x in content.large_graph_order(df, "rcm", most=10).collect()}
    assert got == dict(zip(names, want, strict=True))
    got = {x["id"]: x["new_id"] for x in content.large_graph_order(df, "community", most=10).collect()}
    assert sorted(got) == names and sorted(got.values()) == list(range(len(names)))
