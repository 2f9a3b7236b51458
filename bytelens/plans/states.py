"""Queries that return the states of sketches, codecs, bitmaps and graphs themselves, against SQL that computes each anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.functions import bits as fb
from bytelens.functions import columns as fc
from bytelens.functions import native as fn
from bytelens.functions.sketches import BLOOM_SEEDS, HLL_SEED, Bloom
from bytelens.operators import content, graphs, neighbours, sketching
from bytelens.plans.registry import query, table

_M = "18446744073709551616::UHUGEINT"


def _steps(name: str, source: str, start: str) -> str:
    """CTEs from ``source``, with a 64-bit number ``start``, to ``name`` with its finalized hash ``h``."""
    return f"""{name}_1 AS (SELECT *, ({start} + 11400714819323198485::UHUGEINT) % {_M} AS v FROM {source}),
{name}_2 AS (SELECT * EXCLUDE v, (xor(v, v >> 30) * 13787848793156543929::UHUGEINT) % {_M} AS v FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE v, (xor(v, v >> 27) * 10723151780598845931::UHUGEINT) % {_M} AS v FROM {name}_2),
{name} AS (SELECT * EXCLUDE v, xor(v, v >> 31) AS h FROM {name}_3)"""


def _short(item: str) -> str:
    """The number that seven bytes at most stand for, the first lowest."""
    return f"list_sum(list_transform(range(length({item})), lambda i: ascii(substr({item}, i + 1, 1))::HUGEINT << (8 * i)::INT))::UHUGEINT"


def _mix(name: str, source: str, item: str, seed: int) -> str:
    """mix64 of ASCII strings of seven bytes at most."""
    return _steps(name, f"(SELECT *, xor(xor({seed}::UHUGEINT, (length({item})::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M}), {_short(item)}) AS s FROM {source})", "s")


def _crc(word: str) -> str:
    """CRC-32C without inversions of a 32-bit word."""
    return f"list_reduce(list_prepend(({word})::BIGINT, list_transform(range(32), lambda i: 0::BIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)"


#: Registers of the distinct users of each event type.
_REGISTERS = "WITH u AS (SELECT DISTINCT event_type, user_id::VARCHAR AS item FROM events), " + _mix("m", "u", "item", HLL_SEED) + f""",
r AS (SELECT event_type, (h >> 52)::BIGINT AS idx, ((h << 12) % {_M})::UBIGINT AS rest FROM m),
g AS (SELECT event_type, idx, max(CASE WHEN rest = 0 THEN 53 ELSE 65 - length(bin(rest)) END)::INT AS rank FROM r GROUP BY ALL)"""


def _hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sketching.hll_registers(e, fc.utf8(F.col("user_id").cast("string")), 12, ["event_type"])


@query(_REGISTERS + " SELECT * FROM g")
def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hll(spark, sf_dir).select("event_type", F.col("idx").cast("long").alias("idx"), F.col("rank").cast("int").alias("rank"))


@query(_REGISTERS + """, s AS (SELECT event_type, count(*) AS n, sum(pow(2.0, -rank)) AS s FROM g GROUP BY ALL),
e AS (SELECT *, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (s + 4096 - n) AS raw FROM s)
SELECT event_type, floor(CASE WHEN raw <= 2.5 * 4096 AND n < 4096 THEN 4096 * ln(4096 / (4096 - n)) ELSE raw END + 0.5)::BIGINT AS estimate FROM e""")
def hll_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.hll_estimate(_hll(spark, sf_dir), 12, ["event_type"])


_CELLS = f"""WITH i AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT item, n, r AS row, {_crc("xor(item, (2654435769 * (r + 1)) & 4294967295)")} % 1024 AS cell FROM i, (SELECT unnest(range(4)) AS r)),
t AS (SELECT row, cell, sum(n)::BIGINT AS cnt FROM c GROUP BY ALL)"""


@query(_CELLS + " SELECT row::INT AS row, cell, cnt FROM t")
def count_min_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.count_min(table(spark, sf_dir, "lineitem"), F.col("l_partkey"))


@query(_CELLS + " SELECT item AS l_partkey, min(cnt) AS estimate FROM c JOIN t USING (row, cell) GROUP BY ALL")
def count_min_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return sketching.count_min_estimate(sketching.count_min(li, F.col("l_partkey")), li.select("l_partkey").distinct(), "l_partkey")


_SHAPE = Bloom.sized(20_000, 0.01)


@query("WITH k AS (SELECT DISTINCT o_custkey::VARCHAR AS item FROM orders), " + _mix("a", "k", "item", BLOOM_SEEDS[0]) + ", " + _mix("b", "k", "item", BLOOM_SEEDS[1]) + f""",
p AS (SELECT ((a.h + ((i::UHUGEINT * b.h) % {_M})) % {_M}) % {_SHAPE.bits} AS p FROM a JOIN b USING (item), (SELECT unnest(range({_SHAPE.hashes})) AS i))
SELECT (p // 64)::BIGINT AS word, bit_count(bit_or(1::UBIGINT << (p % 64)::UBIGINT))::INT AS ones, min(p % 64)::INT AS lowest, max(p % 64)::INT AS highest FROM p GROUP BY 1""")
def bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the filter of all customers with orders that hold a one."""
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    bloom = sketching.bloom_filter(o, fc.utf8(F.col("o_custkey").cast("string")), 20_000, 0.01)
    words = spark.createDataFrame([(i, int(w)) for i, w in enumerate(bloom.words.view("<i8").tolist())], "word long, w long").where("w <> 0")
    m = fb.members(F.array("w"))
    return words.select("word", F.bit_count("w").cast("int").alias("ones"), F.array_min(m).cast("int").alias("lowest"), F.array_max(m).cast("int").alias("highest"))


@query("WITH t AS (SELECT b::UHUGEINT AS b, k, xor(b::UHUGEINT, (3 * k + 1)::UHUGEINT) AS s FROM (SELECT unnest(range(256)) AS b), (SELECT unnest(range(16)) AS k)), " + _steps("m", "t", "s") + """,
d AS (SELECT DISTINCT doc_id, ('0x' || h)::INT AS b FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents))
SELECT doc_id, k::INT AS slot, min(h)::VARCHAR AS value FROM d JOIN m ON m.b = d.b GROUP BY ALL""")
def minhash_byte_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots as unsigned numbers in words."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    slots = d.select("doc_id", F.posexplode(fc.minhash_bytes(fc.utf8("text"), [3 * k + 1 for k in range(16)])).alias("slot", "v"))
    v = F.col("v").cast("decimal(20,0)")
    return slots.select("doc_id", "slot", F.when(v < 0, v + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(v).cast("decimal(20,0)").cast("string").alias("value"))


# Codecs and bits ---------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))


_PARTS = "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem)"


@query(_PARTS + """, b AS (SELECT l_orderkey, count(*) AS n, string_agg(reverse(lpad(bin(p), 21, '0')), '' ORDER BY p) AS bits FROM d GROUP BY 1)
SELECT l_orderkey, n, array_to_string(list_transform(range((length(bits) + 7) // 8), lambda i: lpad(hex(list_sum(list_transform(range(8), lambda k: CASE WHEN substr(bits, 8 * i + k + 1, 1) = '1' THEN 1 << k::INT ELSE 0 END))::UTINYINT), 2, '0')), '') AS packed, true AS back FROM b""")
def bit_packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order in 21 bits each, and whether they come back."""
    p = _parts(spark, sf_dir).withColumn("b", fc.bit_pack(F.col("p"), 21))
    return p.select("l_orderkey", F.size("p").cast("long").alias("n"), F.hex("b").alias("packed"), (fc.bit_unpack(F.col("b"), 21, F.size("p")) == F.col("p")).alias("back"))


@query(_PARTS + """, v AS (SELECT l_orderkey, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1 AS i, CASE WHEN p < 256 THEN 1 WHEN p < 65536 THEN 2 WHEN p < 16777216 THEN 3 ELSE 4 END AS n FROM d),
c AS (SELECT l_orderkey, i // 4 AS g, lpad(hex(sum((n - 1) << (2 * (i % 4))::INT)::UTINYINT), 2, '0') AS c FROM v GROUP BY ALL),
x AS (SELECT l_orderkey, string_agg(array_to_string(list_transform(range(n), lambda k: lpad(hex(((p >> (8 * k)::INT) & 255)::UTINYINT), 2, '0')), ''), '' ORDER BY i) AS data FROM v GROUP BY 1)
SELECT l_orderkey, (SELECT string_agg(c, '' ORDER BY g) FROM c WHERE c.l_orderkey = x.l_orderkey) AS control, data, true AS back FROM x""")
def stream_vbyte_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("s", fc.stream_vbyte(F.col("p")))
    return p.select("l_orderkey", F.hex("s.control").alias("control"), F.hex("s.data").alias("data"), (fc.stream_vbyte_decode(F.col("s"), F.size("p")) == F.col("p")).alias("back"))


@query("""SELECT o_orderkey, array_to_string(list_transform(range(n), lambda i: lpad(hex((((o_orderkey >> (7 * i)::INT) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)::UTINYINT), 2, '0')), '') AS raw, o_orderkey AS value, n::INT AS length
FROM (SELECT o_orderkey, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::BIGINT AS n FROM orders)""")
def varint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select("o_orderkey", fc.varint(F.col("o_orderkey")).alias("v"))
    return v.select("o_orderkey", F.hex("v").alias("raw"), fc.varint_decode(F.col("v")).alias("d")).select("o_orderkey", "raw", "d.*")


@query("SELECT doc_id, 'sha2-256' AS code, sha256(text) AS digest FROM documents")
def multihash_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", fc.multihash_decode(fc.sha256_multihash(fc.utf8("text"))).alias("m"))
    return d.select("doc_id", "m.code", F.lower(F.hex("m.digest")).alias("digest"))


@query("""WITH d AS (SELECT l_suppkey AS k, list_distinct(list((l_partkey % 256)::BIGINT)) AS p FROM lineitem GROUP BY 1),
j AS (SELECT a.k, a.p AS a, b.p AS b, list_intersect(a.p, b.p) AS i FROM d a JOIN d b ON b.k = a.k + 1)
SELECT k, len(a)::BIGINT AS n, len(i)::BIGINT AS n_and, (len(a) + len(b) - len(i))::BIGINT AS n_or, (len(a) + len(b) - 2 * len(i))::BIGINT AS n_xor, (len(a) - len(i))::BIGINT AS n_andnot, list_contains(a, 7) AS has7, (len(a) + CASE WHEN list_contains(a, 7) THEN 0 ELSE 1 END)::BIGINT AS n_with7, (len(a) - CASE WHEN list_contains(a, 7) THEN 1 ELSE 0 END)::BIGINT AS n_without7,
  list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only FROM j""")
def bitmap_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of the parts, modulo 256, of each supplier and of the next one."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 256).alias("p"))
    s = s.select("k", fb.bitmap(F.col("p"), 256).alias("a"))
    j = s.join(s.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    a, b, seven = F.col("a"), F.col("b"), F.lit(7)
    n = lambda w, name: fb.popcount(w).alias(name)
    return j.select("k", n(a, "n"), n(fb.bit_and(a, b), "n_and"), n(fb.bit_or(a, b), "n_or"), n(fb.bit_xor(a, b), "n_xor"), n(fb.bit_andnot(a, b), "n_andnot"), fb.contains(a, seven).alias("has7"), n(fb.insert(a, seven), "n_with7"), n(fb.remove(a, seven), "n_without7"), fb.members(fb.bit_andnot(a, b)).alias("only"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 256 AS p FROM lineitem),
b AS (SELECT s.k, r.i, (d.p IS NOT NULL)::INT AS bit FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) s CROSS JOIN (SELECT unnest(range(256)) AS i) r LEFT JOIN d ON d.k = s.k AND d.p = r.i),
w AS (SELECT *, sum(bit) OVER (PARTITION BY k ORDER BY i) - bit AS r1 FROM b)
SELECT k, max(CASE WHEN i = 100 THEN r1 END)::BIGINT AS rank1, max(CASE WHEN i = 100 THEN 100 - r1 END)::BIGINT AS rank0, max(CASE WHEN bit = 1 AND r1 = 3 THEN i END)::BIGINT AS select1, max(CASE WHEN bit = 0 AND i - r1 = 70 THEN i END)::BIGINT AS select0,
  list_sort(list(CASE WHEN i IN (0, 64, 255) THEN r1 END) FILTER (i IN (0, 64, 255)))::BIGINT[] AS ranks, list_sort(list(i) FILTER (bit = 1 AND r1 IN (0, 2)))::BIGINT[] AS selects FROM w GROUP BY k""")
def bit_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and selections, one and many at a time, in the bitmap of each supplier's parts, modulo 256."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 256).alias("p"))
    w = fb.bitmap(F.col("p"), 256)
    s = s.select("k", w.alias("w"))
    w = F.col("w")
    some = lambda *x: F.array(*[F.lit(i) for i in x])
    return s.select("k", fb.rank1(w, F.lit(100)).alias("rank1"), fb.rank0(w, F.lit(100)).alias("rank0"), fb.select1(w, F.lit(3)).alias("select1"), fb.select0(w, F.lit(70)).alias("select0"), fb.ranks(w, some(0, 64, 255)).alias("ranks"), F.filter(fb.selects(w, some(0, 2)), lambda x: x.isNotNull()).alias("selects"))


@query("""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1] > 0 AND p[2] > 0)::INT)) AS i, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1] > 0 OR p[2] > 0)::INT)) AS u
FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0), e AS (SELECT query_id, id, CASE WHEN u = 0 THEN 0 ELSE 1 - i / u END AS d FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM e) SELECT query_id, rank::INT AS rank, id, round(d, 6) + 0 AS distance FROM k WHERE rank <= 5""")
def knn_jaccard_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", fn.sign_words(F.col("embedding")).alias("embedding"))
    n = neighbours.nearest(v, v.where(F.col("vec_id") % 20 == 0), 5, "jaccard_bits")
    return n.select("query_id", "rank", "id", (F.round("distance", 6) + 0.0).alias("distance"))


# Graphs and orders -------------------------------------------------------------------------------


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' nations by orders between them."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = j.where(F.col("s_nationkey") != F.col("c_nationkey")).select(F.least("s_nationkey", "c_nationkey").cast("long").alias("src"), F.greatest("s_nationkey", "c_nationkey").cast("long").alias("dst"))
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"))


_TRADE = """WITH e AS (SELECT least(s_nationkey, c_nationkey)::BIGINT AS src, greatest(s_nationkey, c_nationkey)::BIGINT AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
n AS (SELECT src AS id, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


@query(_TRADE + " SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength, list_sort(list(other)) AS neighbours FROM n GROUP BY id")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency(_trade(spark, sf_dir))


@query(_TRADE + """, s AS (SELECT id, sum(weight) AS d FROM n GROUP BY id)
SELECT src, dst, (weight * (SELECT sum(d) FROM s) - a.d * b.d)::BIGINT AS gain FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst""")
def modularity_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.modularity_gains(_trade(spark, sf_dir))


@query("""WITH p AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS new_id, row_number() OVER (ORDER BY c_custkey) - 1 AS old FROM customer)
SELECT new_id AS place, id, c_name AS name FROM p JOIN customer ON c_custkey = id""")
def permuted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put in the order of a permutation that is checked first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    order = content.numbered(c.select("id", "c_acctbal"), ["c_acctbal", "id"], "new_id").select("id", "new_id")
    return graphs.permute(c.select("id", "name"), order).select(F.col("new_id").alias("place"), "id", "name")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS bin FROM lineitem), p AS (SELECT id AS src, lead(id) OVER (PARTITION BY bin ORDER BY id) AS dst FROM d)
SELECT src, dst, count(*) AS weight FROM p WHERE dst IS NOT NULL GROUP BY ALL""")
def bin_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that follow each other among those of a supplier."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("bins"))
    return graphs.bin_chain(rows)


@query("""WITH b AS (SELECT doc_id, h, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL)
SELECT doc_id, false AS zero_filled, coalesce(sum(n) FILTER (h = '00'), 0) * 100 >= 95 * sum(n) AS sparse, count(*) <= 16 AS low_cardinality,
  sum(n) FILTER (h IN ('09', '0A', '0D') OR h BETWEEN '20' AND '7E') * 10 >= 9 * sum(n) AS text_like, false AS skips_compression FROM b GROUP BY doc_id""")
def payload_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fc.utf8("text")
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.structure(x).alias("s"), fc.extent_fingerprint(x).alias("f"))
    s, f = F.col("s"), F.col("f")
    return d.select("doc_id", fn.is_zero_filled(s).alias("zero_filled"), fn.is_sparse(s).alias("sparse"), fn.is_low_cardinality(s).alias("low_cardinality"), fn.is_text_like(s).alias("text_like"), fn.skips_compression(f).alias("skips_compression"))


@query("""WITH r AS (SELECT min(c_acctbal::DOUBLE) AS a, max(c_acctbal::DOUBLE) AS b, min(c_nationkey::DOUBLE) AS c, max(c_nationkey::DOUBLE) AS d FROM customer),
g AS (SELECT c_custkey AS id, least(65535, floor((c_acctbal::FLOAT - a::FLOAT) / (b - a)::FLOAT * 65535::FLOAT + 0.5::FLOAT))::BIGINT AS x,
  least(65535, floor((c_nationkey::FLOAT - c::FLOAT) / (d - c)::FLOAT * 65535::FLOAT + 0.5::FLOAT))::BIGINT AS y FROM customer, r),
f AS (SELECT id, list_reduce(list_transform(range(15), lambda i: {'x': 0::BIGINT, 'y': 0::BIGINT, 'q': 32768::BIGINT >> i}), lambda s, u: {
    'x': CASE WHEN s.y & u.q <> 0 THEN xor(CASE WHEN s.x & u.q <> 0 THEN xor(s.x, u.q - 1) ELSE s.x END, u.q - 1)
      ELSE xor(CASE WHEN s.x & u.q <> 0 THEN xor(s.x, u.q - 1) ELSE s.x END, xor(CASE WHEN s.x & u.q <> 0 THEN xor(s.x, u.q - 1) ELSE s.x END, s.y) & (u.q - 1)) END,
    'y': CASE WHEN s.y & u.q <> 0 THEN s.y ELSE xor(s.y, xor(CASE WHEN s.x & u.q <> 0 THEN xor(s.x, u.q - 1) ELSE s.x END, s.y) & (u.q - 1)) END, 'q': u.q}, {'x': x, 'y': y, 'q': 0::BIGINT}) AS s FROM g),
h AS (SELECT id, s.x AS x, xor(s.x, s.y) AS y FROM f),
k AS (SELECT id, x, y, list_reduce(list_prepend(0::BIGINT, list_transform(range(15), lambda i: 32768::BIGINT >> i)), lambda t, q: CASE WHEN y & q <> 0 THEN xor(t, q - 1) ELSE t END) AS t FROM h),
z AS (SELECT id, list_sum(list_transform(range(16), lambda i: ((xor(x, t) >> i & 1) * 2 + (xor(y, t) >> i & 1))::HUGEINT << (2 * i)::INT)) AS key FROM k)
SELECT id, row_number() OVER (ORDER BY key, id) - 1 AS new_id FROM z""")
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers along a curve through balance and nation; tests hold the order of more dimensions against a plain transform."""
    c = table(spark, sf_dir, "customer")
    return content.hilbert_points(c, "c_custkey", F.col("c_acctbal"), F.col("c_nationkey"))


@query()
def simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: documents whose 64-bit signatures over words differ in three bits at most; tests hold the join against all pairs."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").where(F.size(words) > 20).select("doc_id", fc.simhash_items(words).alias("s"))
    return neighbours.simhash_pairs(d, "doc_id", F.col("s"), most=3)


def _word(k: int, n: int) -> str:
    """The number that n of the bytes ``b`` from 8 * k on stand for, the first lowest."""
    return f"list_sum(list_transform(range({n}), lambda i: b[{8 * k} + i + 1]::HUGEINT << (8 * i)::INT))::UHUGEINT"


def _signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - 18446744073709551616 ELSE {h}::HUGEINT END)::BIGINT"


@query(f"""WITH c AS (SELECT c_custkey, list_transform(range(length(c_name)), lambda i: ascii(substr(c_name, i + 1, 1))::BIGINT) AS b FROM customer),
{_steps("x", "c", f"xor(xor(7::UHUGEINT, (18::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M}), {_word(0, 8)})")},
{_steps("y", "(SELECT c_custkey, b, h AS g FROM x)", f"xor(g, {_word(1, 8)})")},
{_steps("z", "(SELECT c_custkey, b, h AS g FROM y)", f"xor(g, {_word(2, 2)})")},
f AS (SELECT c_custkey, h, list_reduce(list_transform(b, lambda v: v::UHUGEINT), lambda a, v: (xor(a, v) * 1099511628211::UHUGEINT) % {_M}, 14695981039346656037::UHUGEINT) AS fnv,
  list_reduce(list_prepend(0::BIGINT, b), lambda a, v: list_reduce(list_prepend(xor(a, v), list_transform(range(8), lambda i: 0::BIGINT)), lambda c, w: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)) AS crc FROM z)
SELECT c_custkey, {_signed("fnv")} AS fnv, {_signed("h")} AS mix, crc FROM f""")
def hash_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the customers' names, 18 letters each."""
    d = table(spark, sf_dir, "customer").select("c_custkey", fc.utf8("c_name").alias("x"))
    return d.select("c_custkey", fc.fnv1a64(F.col("x")).alias("fnv"), fc.mix64(F.col("x"), 7).alias("mix"), fc.crc32c_raw(F.col("x")).cast("long").alias("crc"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN repeat('00', 256) WHEN 1 THEN repeat('00', 255) || '78'
    WHEN 2 THEN list_aggregate(list_transform(range(64), lambda i: sha256(p_partkey || '-' || i)), 'string_agg', '') ELSE lower(hex(encode(p_name))) END AS x FROM part),
b AS (SELECT k, i, x[2 * i - 1:2 * i] AS h FROM (SELECT *, unnest(range(1, length(x) // 2 + 1)) AS i FROM p)),
n AS (SELECT k, h, count(*) AS c FROM b GROUP BY ALL), e AS (SELECT k, sum(c) AS n, -sum(c * log2(c)) / sum(c) + log2(sum(c)) AS h1, coalesce(sum(c) FILTER (h = '00'), 0) AS zeros FROM n GROUP BY k),
r AS (SELECT k, run, count(*) AS c FROM (SELECT k, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, CASE WHEN h = lag(h) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS new FROM b)) GROUP BY ALL),
l AS (SELECT k, coalesce(sum(c) FILTER (c >= 4), 0) AS held FROM r GROUP BY k)
SELECT k AS p_partkey, n::BIGINT AS total, zeros = n AS zero_filled, zeros * 100 >= 95 * n AS sparse, h1 >= 7.9 AND held / n < 0.01 AS skips_compression FROM e JOIN l USING (k)""")
def made_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros, nearly zeros, digests and names, by the part's number: every predicate is true of some and false of others."""
    k = F.col("p_partkey")
    digests = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sha2(F.concat_ws("-", k.cast("string"), i.cast("string")), 256)), "")
    made = F.when(k % 4 == 0, F.repeat(F.lit("00"), 256)).when(k % 4 == 1, F.concat(F.repeat(F.lit("00"), 255), F.lit("78"))).when(k % 4 == 2, digests).otherwise(F.hex(fc.utf8("p_name")))
    d = table(spark, sf_dir, "part").select("p_partkey", F.unhex(made).alias("x")).select("p_partkey", fc.structure(F.col("x")).alias("s"), fc.extent_fingerprint(F.col("x")).alias("f"))
    return d.select("p_partkey", F.col("s.total").cast("long").alias("total"), fn.is_zero_filled(F.col("s")).alias("zero_filled"), fn.is_sparse(F.col("s")).alias("sparse"), fn.skips_compression(F.col("f")).alias("skips_compression"))


@query("WITH k AS (SELECT DISTINCT l_partkey AS item FROM lineitem), " + _steps("a", "k", f"xor(item::UHUGEINT, {BLOOM_SEEDS[0]}::UHUGEINT)") + ", " + _steps("b", "k", f"xor(item::UHUGEINT, {BLOOM_SEEDS[1]}::UHUGEINT)") + f""",
p AS (SELECT ((a.h + ((i::UHUGEINT * (CASE WHEN b.h % 2 = 0 THEN b.h + 1 ELSE b.h END)) % {_M})) % {_M}) % {_SHAPE.bits} AS p FROM a JOIN b USING (item), (SELECT unnest(range({_SHAPE.hashes})) AS i)),
n AS (SELECT count(*) AS n FROM k)
SELECT (p // 64)::BIGINT AS word, bit_count(bit_or(1::UBIGINT << (p % 64)::UBIGINT))::INT AS ones, min(p % 64)::INT AS lowest, max(p % 64)::INT AS highest, round(any_value(pow(1 - exp(-n * {_SHAPE.hashes}.0 / {_SHAPE.bits}), {_SHAPE.hashes})), 9) AS rate FROM p, n GROUP BY 1""")
def bloom_key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a filter of all ordered parts, by their numbers, and the rate that so many items give."""
    parts = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    bloom = sketching.bloom_filter(parts, F.col("l_partkey"), 20_000, 0.01)
    words = spark.createDataFrame([(i, int(w), bloom.n) for i, w in enumerate(bloom.words.view("<i8").tolist())], "word long, w long, n long").where("w <> 0")
    m = fb.members(F.array("w"))
    rate = F.round(fn.bloom_rate(F.col("n"), bloom.bits, bloom.hashes), 9)
    return words.select("word", F.bit_count("w").cast("int").alias("ones"), F.array_min(m).cast("int").alias("lowest"), F.array_max(m).cast("int").alias("highest"), rate.alias("rate"))
