"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.functions import columns as fc
from bytelens.functions import native as fn
from bytelens.functions.chunking import ChunkSizes
from bytelens.operators import content, histograms, neighbours, sketching
from bytelens.plans import states, stores  # noqa: F401  (register their queries)
from bytelens.plans.registry import ORACLE_SQL, QUERIES, query, table
from bytelens.scratch import shared_folder

#: Bytes of every document: i from 0, h its hex form, x its value.
BYTES = """WITH b AS (
  SELECT doc_id, lang, i, h, ('0x' || h)::INT AS x FROM (
    SELECT doc_id, lang, unnest(range(len(l))) AS i, unnest(l) AS h FROM (
      SELECT doc_id, lang, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents))
)"""


def text_bytes():
    """The payload of a document; made at each use, as a column needs a session."""
    return fc.utf8("text")


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


# Histograms and entropy --------------------------------------------------------------------------


@query(BYTES + """, c AS (SELECT doc_id, lang, h, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT doc_id, lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1 FROM c GROUP BY ALL)
SELECT lang, count(*) AS n_docs, round(avg(h1), 6) AS mean_bits FROM d GROUP BY lang""")
def entropy_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average bits per byte of a document, by language."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    bits = docs.select("lang", fn.entropy(fc.byte_counts(text_bytes())).alias("h1"))
    return bits.groupBy("lang").agg(F.count("*").alias("n_docs"), r6(F.avg("h1"), "mean_bits"))


@query(BYTES + " SELECT lang, x::BIGINT AS byte, count(*) AS cnt FROM b GROUP BY ALL")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.ngram_histogram(table(spark, sf_dir, "documents"), text_bytes(), 1, ["lang"]).withColumnRenamed("gram", "byte")


@query(BYTES + """, p AS (SELECT lang, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM b)
SELECT lang, (x + 256 * y)::BIGINT AS gram, count(*) AS cnt FROM p WHERE y IS NOT NULL GROUP BY ALL""")
def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.ngram_histogram(table(spark, sf_dir, "documents"), text_bytes(), 2, ["lang"])


@query(BYTES + """, p AS (SELECT lang, h || lead(h, 1) OVER w || lead(h, 2) OVER w || lead(h, 3) OVER w AS g FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT lang, g, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY ALL)
SELECT lang, count(*) AS distinct_grams, sum(n)::BIGINT AS observations, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM c GROUP BY lang""")
def ngram4_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histograms.ngram_histogram(table(spark, sf_dir, "documents"), text_bytes(), 4, ["lang"])
    n = F.col("cnt")
    return h.groupBy("lang").agg(F.count("*").alias("distinct_grams"), F.sum(n).alias("observations"), r6(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n), "bits"))


@query(BYTES + """, c AS (SELECT doc_id, h, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1, -log2(max(n) / sum(n)) AS hm, -log2(sum((n / t) * (n / t))) AS h2r FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id),
p AS (SELECT doc_id, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
q AS (SELECT doc_id, h, g, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY ALL),
j AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h2 FROM q GROUP BY doc_id),
f AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hp FROM (SELECT doc_id, h, sum(n) AS n FROM q GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, round(h1, 5) + 0 AS h1, round(hm, 5) + 0 AS h_min, round(h2r, 5) + 0 AS renyi2, round(coalesce(h2, 0), 5) + 0 AS h2, round(greatest(coalesce(h2 - hp, 0), 0), 5) + 0 AS h_next
FROM h LEFT JOIN j USING (doc_id) LEFT JOIN f USING (doc_id)""")
def document_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.entropies(text_bytes()).alias("e"))
    return d.select("doc_id", *[(F.round(F.col(f"e.{k}"), 5) + 0.0).alias(k) for k in ("h1", "h_min", "renyi2", "h2", "h_next")])


@query(BYTES + """, m AS (SELECT *, avg(x) OVER (PARTITION BY doc_id) AS mu FROM b),
s AS (SELECT doc_id, count(*) AS n, any_value(mu) AS mu, sum((x - mu) ** 2) AS m2, sum((x - mu) ** 3) AS m3, sum((x - mu) ** 4) AS m4 FROM m GROUP BY doc_id)
SELECT doc_id, n, round(mu, 4) AS mean, round(CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0 END, 4) AS variance,
  round(CASE WHEN m2 > 0 THEN sqrt(n) * m3 / m2 ** 1.5 ELSE 0 END, 4) + 0 AS skewness, round(CASE WHEN m2 > 0 THEN n * m4 / (m2 * m2) - 3 ELSE 0 END, 4) + 0 AS kurtosis FROM s""")
def byte_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.byte_moments(text_bytes()).alias("m"))
    return d.select("doc_id", "m.n", *[(F.round(F.col(f"m.{k}"), 4) + 0.0).alias(k) for k in ("mean", "variance", "skewness", "kurtosis")])


@query(BYTES + """ SELECT doc_id, count(*) FILTER (x IN (9, 10, 13, 32)) AS whitespace, count(*) FILTER (x BETWEEN 33 AND 126) AS printable,
  count(*) FILTER (x = 127 OR (x < 32 AND x NOT IN (9, 10, 13))) AS control, count(*) FILTER (x > 127) AS high FROM b GROUP BY doc_id""")
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.byte_classes(text_bytes()).alias("c")).select("doc_id", "c.*")


@query(BYTES + """, e AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
r AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS total, count(*) - 1 AS transitions, max(n) AS longest_run, count(*) FILTER (n >= 4) AS runs_ge4, coalesce(sum(n) FILTER (n >= 4), 0)::BIGINT AS bytes_in_runs FROM r GROUP BY doc_id""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.run_lengths(text_bytes()).alias("r")).select("doc_id", "r.*")


@query(BYTES + """ SELECT doc_id, count(DISTINCT x) AS distinct_bytes, count(*) FILTER (x = 0) AS zeros, count(DISTINCT x) <= 16 AS low_cardinality,
  count(*) FILTER (x IN (9, 10, 13) OR x BETWEEN 32 AND 126) * 10 >= 9 * count(*) AS ascii_dominant, count(*) FILTER (x = 0) * 100 >= 95 * count(*) AS sparse FROM b GROUP BY doc_id""")
def structure_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.structure(text_bytes()).alias("s"))
    s = lambda k: F.col(f"s.{k}")
    return d.select("doc_id", s("distinct").alias("distinct_bytes"), s("zeros").alias("zeros"), (s("distinct") <= 16).alias("low_cardinality"), ((s("whitespace") + s("printable")) * 10 >= 9 * s("total")).alias("ascii_dominant"), (s("zeros") * 100 >= 95 * s("total")).alias("sparse"))


#: Byte shares of every language, on all 256 bins.
SHARES = BYTES + """, n AS (SELECT lang, x, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT l.lang, r.x, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM n) l CROSS JOIN (SELECT unnest(range(256))::INT AS x) r LEFT JOIN n ON n.lang = l.lang AND n.x = r.x),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p, (n + 0.5) / sum(n + 0.5) OVER (PARTITION BY lang) AS s, sum(n) OVER (PARTITION BY lang ORDER BY x) / sum(n) OVER (PARTITION BY lang) AS cdf FROM g)"""


@query(SHARES + """
SELECT a.lang AS a, c.lang AS b, round(sum(abs(a.p - c.p)) / 2, 6) AS tv, round(max(abs(a.cdf - c.cdf)), 6) AS ks, round(greatest(0, sum(a.s * ln(a.s / c.s))), 6) AS kl,
  round(sqrt(greatest(0, sum(a.s * ln(2 * a.s / (a.s + c.s)) + c.s * ln(2 * c.s / (a.s + c.s))) / 2)), 6) AS js, round(sqrt(sum((sqrt(a.p) - sqrt(c.p)) ** 2) / 2), 6) AS hellinger,
  round(sum(CASE WHEN a.p + c.p > 0 THEN (a.p - c.p) ** 2 / (a.p + c.p) ELSE 0 END), 6) AS triangular, round(sqrt(sum((a.p - c.p) ** 2)), 6) AS l2_normalized,
  round(sqrt(sum((a.n - c.n)::DOUBLE ** 2)), 3) AS l2, round(1 - sum(a.n::DOUBLE * c.n) / sqrt(sum(a.n::DOUBLE * a.n) * sum(c.n::DOUBLE * c.n)), 6) AS cosine
FROM p a JOIN p c ON a.x = c.x AND a.lang < c.lang GROUP BY ALL""")
def language_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = histograms.dense(histograms.ngram_histogram(table(spark, sf_dir, "documents"), text_bytes(), 1, ["lang"]), ["lang"])
    p = d.alias("p").join(d.alias("q"), F.col("p.lang") < F.col("q.lang"))
    a, b = F.col("p.counts"), F.col("q.counts")
    return p.select(
        F.col("p.lang").alias("a"), F.col("q.lang").alias("b"), r6(fn.total_variation(a, b), "tv"), r6(fn.kolmogorov_smirnov(a, b), "ks"), r6(fn.kullback_leibler(a, b, 0.5), "kl"), r6(fn.jensen_shannon(a, b), "js"), r6(fn.hellinger(a, b), "hellinger"),
        r6(fn.triangular(a, b), "triangular"), r6(fn.l2_counts(a, b, normalized=True), "l2_normalized"), F.round(fn.l2_counts(a, b), 3).alias("l2"), r6(fn.cosine_counts(a, b), "cosine"),
    )


@query(SHARES + """, d AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS q FROM d),
m AS (SELECT q.doc_id, p.lang, sqrt(greatest(0, 1 - sum(sqrt(q.q * p.p)))) AS d FROM q JOIN p ON p.x = q.x GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), lang) AS k FROM m)
SELECT doc_id, lang AS nearest, round(d, 5) + 0 AS distance FROM k WHERE k = 1""")
def nearest_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    refs = histograms.dense(histograms.ngram_histogram(docs, text_bytes(), 1, ["lang"]), ["lang"])
    counted = docs.select("doc_id", fc.byte_counts(text_bytes()).alias("counts"))
    metric = lambda a, b: F.round(fn.hellinger(a, b), 9)
    near = histograms.nearest_reference(counted, "counts", refs, metric, key="lang")
    return near.select("doc_id", "nearest", (F.round("distance", 5) + 0.0).alias("distance"))


# Identity ----------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, count(*) AS copies, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY ALL")
def sha256_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.sum("n").alias("n_bytes"))


@query("""WITH h AS (SELECT doc_id, '1220' || sha256(text) AS m FROM documents),
b AS (SELECT doc_id, m, array_to_string(list_transform(string_split('0155' || m, ''), lambda c: CASE c WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100'
  WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') || '00' AS bits FROM h)
SELECT doc_id, m AS multihash, 'b' || array_to_string(list_transform(range(58), lambda k: substr('abcdefghijklmnopqrstuvwxyz234567',
  1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS cid FROM b""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.hex(fc.sha256_multihash(text_bytes()))).alias("multihash"), fc.sha256_cid(text_bytes()).alias("cid"))


@query("SELECT n, count(*) AS keys FROM (SELECT greatest(1, ceil(length(bin(l_orderkey)) / 7.0))::INT AS n FROM lineitem) GROUP BY n")
def varint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(fn.varint_len(F.col("l_orderkey")).cast("int").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


@query()
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that SQL has no word for; tests hold them against their published values."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey"), fc.utf8("c_name").alias("x"))
    return d.select("c_custkey", fc.fnv1a64(F.col("x")).alias("fnv"), fc.mix64(F.col("x"), 7).alias("mix"), fc.crc32c_raw(F.col("x")).alias("crc"), F.lower(F.hex(fc.blake3(F.col("x")))).alias("blake3"))


# Sketches ----------------------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")
def hll_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from registers, held against the exact count."""
    e = table(spark, sf_dir, "events")
    item = fc.utf8(F.col("user_id").cast("string"))
    est = sketching.hll_estimate(sketching.hll_registers(e, item, 12, ["event_type"]), 12, ["event_type"])
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(est, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.08 * F.col("users") + 2).alias("close"))


@query("SELECT l_partkey, count(*) AS cnt, true AS not_below FROM lineitem GROUP BY l_partkey")
def count_min_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts beside whether the sketch's estimate is at least that, as it must be."""
    li = table(spark, sf_dir, "lineitem")
    cells = sketching.count_min(li, F.col("l_partkey"))
    exact = li.groupBy("l_partkey").agg(F.count("*").alias("cnt"))
    est = sketching.count_min_estimate(cells, exact, "l_partkey")
    return exact.join(est, "l_partkey").select("l_partkey", "cnt", (F.col("estimate") >= F.col("cnt")).alias("not_below"))


@query("WITH c AS (SELECT l_suppkey AS item, count(*) AS cnt FROM lineitem GROUP BY 1) SELECT item, cnt, true AS within FROM c WHERE cnt > (SELECT count(*) FROM lineitem) / 201.0")
def heavy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item above n / (k + 1) is held, and its count lies within the bounds."""
    li = table(spark, sf_dir, "lineitem")
    n = li.count()
    held = sketching.heavy_hitters(li, F.col("l_suppkey"), 200)
    exact = li.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("cnt"))
    heavy = exact.where(F.col("cnt") > n / 201.0)
    return heavy.join(held, "item", "left").select("item", "cnt", F.coalesce((F.col("low") <= F.col("cnt")) & (F.col("cnt") <= F.col("high")), F.lit(False)).alias("within"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def bloom_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders: a filter of bounded size goes first, the join decides."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = lambda x: fc.utf8(F.col(x).cast("string"))
    bloom = sketching.bloom_filter(o.select("o_custkey").distinct(), key("o_custkey"), 20_000, 0.01)
    kept = c.where(sketching.bloom_contains(key("c_custkey"), bloom))
    return kept.join(o, kept["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def streamed_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    est = sketching.ordered_quantile(e, "value", "event_id", 0.5, ["event_type"])
    exact = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.45)).alias("lo"), F.percentile("value", F.lit(0.55)).alias("hi"))
    return est.join(exact, "event_type").select("event_type", ((F.col("estimate") >= F.col("lo")) & (F.col("estimate") <= F.col("hi"))).alias("close"))


# Similarity --------------------------------------------------------------------------------------

WORD_SETS = "WITH s AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)"
PAIRS = WORD_SETS + """, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS t FROM s a JOIN s b ON a.id < b.id WHERE least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND len(a.w) > 0)
SELECT a, b, round(i / (t - i), 6) AS jaccard FROM p WHERE i / (t - i) >= 0.8"""


def _word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))


@query(PAIRS)
def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = neighbours.set_similarity_join(_word_sets(spark, sf_dir), "id", F.col("w"), 0.8)
    return p.select("a", "b", r6(F.col("jaccard"), "jaccard"))


@query(PAIRS)
def lsh_verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of 32 bands of 4 minima (all but 5e-8 of the pairs at 0.8), then the sets themselves."""
    bands = content.minhash_bands(content.minhash(F.col("w"), 128, 11), 32)
    p = neighbours.set_similarity_join(_word_sets(spark, sf_dir), "id", F.col("w"), 0.8, bands=bands)
    return p.select("a", "b", r6(F.col("jaccard"), "jaccard"))


@query()
def minhash_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _word_sets(spark, sf_dir)
    seeds = [3 * k + 1 for k in range(16)]
    w = F.col("w")
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fc.minhash_bytes(text_bytes(), seeds).alias("by_byte"), fc.simhash_bytes(text_bytes(), list(range(64))).alias("simhash_bytes"))
    return s.select("id", content.minhash(w, 32, 1, "one_permutation").alias("one_permutation"), content.minhash(w, 32, 1, "densified").alias("densified"), content.simhash(w).alias("simhash")).join(text, "id")


@query("""WITH g AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\s]+') AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\\s]+') AS w FROM documents))
SELECT doc_id, item_id, count(DISTINCT g) AS shared FROM d JOIN g USING (g) GROUP BY ALL""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight words that a document has in common with a benchmark item."""
    from bytelens.scratch import Scratch

    def grams(t: DataFrame, id_col: str) -> DataFrame:
        t = t.select(id_col, F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0)).alias("w"))
        last = F.size("w") - 7
        runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))
        return t.where(last >= 1).select(id_col, F.explode(F.array_distinct(runs)).alias("g"))

    def hashes(t: DataFrame, id_col: str) -> DataFrame:
        """A hash for each run, of the hashes of its words, so that no run is put together."""
        one = F.array(F.struct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0)), lambda w: F.xxhash64(w)).alias("h")))
        at = lambda h: F.when(F.size(h) > 7, F.sequence(F.lit(0), F.size(h) - 8))
        runs = F.flatten(F.transform(one, lambda s: F.transform(at(s["h"]), lambda i: F.xxhash64(*[F.get(s["h"], i + k) for k in range(8)]))))
        return t.select(id_col, F.explode(runs).alias("h"))

    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scratch = Scratch(spark)
    items = scratch.save(grams(bench, "item_id"))
    # Documents that hold the hash of any run of the benchmark, from hashes alone; only theirs are compared as text.
    known = scratch.save(hashes(bench, "item_id").select("h").distinct())
    known = F.broadcast(known) if known.count() <= 1_000_000 else known
    some = hashes(docs, "doc_id").join(known, "h", "left_semi").select("doc_id").distinct()
    return grams(docs.join(some, "doc_id", "left_semi"), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query()
def fuzzy_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", fc.ctph(text_bytes()).alias("c"), F.lower(F.hex(fc.quartile_digest(text_bytes()))).alias("quartiles")).select("conv_id", "turn", "c.*", "quartiles")


# Vectors -----------------------------------------------------------------------------------------


def _knn(sql: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {sql} AS d FROM v JOIN v q ON q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d) SELECT query_id, rank::INT AS rank, id, round(d, 5) + 0 AS distance FROM k WHERE rank <= 5"""


def _nearest(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    n = neighbours.nearest(v, v.where(F.col("vec_id") % 20 == 0), 5, metric)
    return n.select("query_id", "rank", "id", (F.round("distance", 5) + 0.0).alias("distance"))


@query(_knn("list_distance(q.e, v.e)"))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries are every twentieth vector, against all."""
    return _nearest(spark, sf_dir, "l2")


@query(_knn("1 - list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e))"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine")


@query(_knn("-list_inner_product(q.e, v.e)"))
def knn_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "inner_product")


@query("""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT))::INT AS bits
FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bits, id) AS rank FROM d) SELECT query_id, rank::INT AS rank, id, bits FROM k WHERE rank <= 5""")
def knn_sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the signs of the components alone; every twentieth vector against all, whatever their labels."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", fn.sign_words(F.col("embedding")).alias("embedding"))
    n = neighbours.nearest(v, v.where(F.col("vec_id") % 20 == 0), 5, "hamming")
    return n.select("query_id", "rank", "id", F.col("distance").cast("int").alias("bits"))


@query()
def graph_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of graph files that hold every vector, for every twentieth; tests measure its recall."""
    from bytelens.sources.files import graph_files, graph_nearest

    v = table(spark, sf_dir, "embeddings")
    return graph_nearest(v.where(F.col("vec_id") % 20 == 0), graph_files(v), k=5)


# Sets, codecs, orders ----------------------------------------------------------------------------


@query("SELECT DISTINCT a.l_orderkey AS id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'")
def postings_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.postings(table(spark, sf_dir, "lineitem"), "l_orderkey", F.array("l_returnflag"))
    return neighbours.all_of(index, ["R", "A"])


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N'))")
def postings_but_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.postings(table(spark, sf_dir, "lineitem"), "l_orderkey", F.array("l_returnflag"))
    return neighbours.but_not(neighbours.any_of(index, ["R"]), index, ["A", "N"])


@query("""WITH s AS (SELECT l_suppkey AS k, list_distinct(list(l_partkey)) AS p FROM lineitem GROUP BY 1)
SELECT a.k, len(list_intersect(a.p, b.p)) AS n_and, len(list_distinct(list_concat(a.p, b.p))) AS n_or, len(a.p) - len(list_intersect(a.p, b.p)) AS n_less,
  len(a.p) + len(b.p) - 2 * len(list_intersect(a.p, b.p)) AS n_xor FROM s a JOIN s b ON b.k = a.k + 1""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each supplier and of the next one."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"))
    n = s.select((F.col("k") - 1).alias("k"), F.col("p").alias("q"))
    a, b = F.col("p"), F.col("q")
    size = lambda c, name: F.size(c).cast("long").alias(name)
    return s.join(n, "k").select("k", size(fn.intersect(a, b), "n_and"), size(fn.union(a, b), "n_or"), size(fn.difference(a, b), "n_less"), size(fn.symmetric_difference(a, b), "n_xor"))


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), g AS (SELECT l_partkey, l_orderkey - coalesce(lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey), 0) AS gap FROM d)
SELECT l_partkey, count(*) AS n, max(gap) AS largest, sum(gap)::BIGINT AS last, sum(CASE WHEN gap < 256 THEN 1 WHEN gap < 65536 THEN 2 WHEN gap < 16777216 THEN 3 ELSE 4 END)::BIGINT AS vbytes, ceil(count(*) / 4.0)::BIGINT AS control FROM g GROUP BY l_partkey""")
def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each posting list, and its size in the byte-wise code, from the code itself."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("o"))
    gaps = p.select("l_partkey", fn.gaps(F.col("o")).alias("g"))
    s = gaps.select("l_partkey", "g", fc.stream_vbyte(F.col("g")).alias("s"))
    return s.select("l_partkey", F.size("g").cast("long").alias("n"), F.array_max("g").alias("largest"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x).alias("last"), F.octet_length("s.data").cast("long").alias("vbytes"), F.octet_length("s.control").cast("long").alias("control"))


@query("SELECT o_orderkey AS pos, (o_orderstatus = 'F')::INT AS bit, coalesce(sum((o_orderstatus = 'F')::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM orders")
def bit_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").cast("int").alias("bit"))
    return neighbours.ranks(o).select("pos", "bit", "rank1")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS total_bytes, true AS sized FROM documents WHERE octet_length(encode(text)) > 0")
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cover their documents, and only the last may be under the least size."""
    sizes = ChunkSizes.around(1024, 1)
    c = content.chunk_rows(table(spark, sf_dir, "documents"), text_bytes(), sizes, ["doc_id"])
    n = F.col("end") - F.col("start")
    g = c.groupBy("doc_id").agg(F.sum(n).alias("total_bytes"), F.max("end").alias("e"), F.count_if(n < sizes.min_size).alias("short"), F.max(n).alias("top"))
    return g.select("doc_id", "total_bytes", ((F.col("short") <= 1) & (F.col("top") <= sizes.max_size) & (F.col("e") == F.col("total_bytes"))).alias("sized"))


@query()
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.chunk_dedup(content.chunk_rows(table(spark, sf_dir, "documents"), text_bytes(), ChunkSizes.around(1024, 1), ["doc_id"]))


@query(BYTES + """, c AS (SELECT doc_id, h, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1, list_sum(list_slice(list_reverse_sort(list(n)), 1, 16)) / sum(n) AS t FROM c GROUP BY doc_id),
e AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
r AS (SELECT doc_id, coalesce(sum(n) FILTER (n >= 4), 0) / sum(n) AS f FROM (SELECT doc_id, run, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, round(h1, 4) + 0 AS h1, round(f, 5) AS rl_fraction, round(t, 5) AS top16_coverage FROM s JOIN r USING (doc_id)""")
def extent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", fc.extent_fingerprint(text_bytes()).alias("f"))
    return d.select("doc_id", (F.round("f.h1", 4) + 0.0).alias("h1"), F.round("f.rl_fraction", 5).alias("rl_fraction"), F.round("f.top16_coverage", 5).alias("top16_coverage"))


@query()
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.build_plan(table(spark, sf_dir, "documents"), "doc_id", text_bytes())


@query(BYTES + """, t AS (SELECT list(list_reduce(list_prepend(v, list_transform(range(8), lambda i: 0::BIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) ORDER BY v) AS t FROM (SELECT unnest(range(256))::BIGINT AS v)),
k AS (SELECT doc_id, i // 256 AS block, i, x FROM b WHERE i < (SELECT max(i) + 1 FROM b z WHERE z.doc_id = b.doc_id) // 256 * 256),
e AS (SELECT *, coalesce((x = lag(x) OVER w)::INT, 0) AS same, x + 256 * lead(x, 1) OVER w + 65536 * lead(x, 2) OVER w + 16777216 * lead(x, 3) OVER w::BIGINT AS g FROM k WINDOW w AS (PARTITION BY doc_id, block ORDER BY i)),
r AS (SELECT doc_id, block, count(*) AS runs FROM (SELECT doc_id, block, run FROM (SELECT doc_id, block, sum(1 - same) OVER (PARTITION BY doc_id, block ORDER BY i) AS run FROM e) GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL),
c AS (SELECT doc_id, block, x, count(*) AS n FROM k GROUP BY ALL),
h AS (SELECT doc_id, block, 8 - sum(n * log2(n)) / 256 AS h1, list_sum(list_slice(list_reverse_sort(list(n)), 1, 4))::INT AS top, coalesce(sum(n) FILTER (x BETWEEN 33 AND 126), 0) AS p, coalesce(sum(n) FILTER (x IN (9, 10, 13, 32)), 0) AS w, coalesce(sum(n) FILTER (x < 32), 0) AS o, coalesce(sum(n) FILTER (x > 127), 0) AS z FROM c GROUP BY ALL),
s1 AS (SELECT doc_id, block, xor(t[(g & 255) + 1], g >> 8) AS g FROM e, t WHERE g IS NOT NULL), s2 AS (SELECT doc_id, block, xor(t[(g & 255) + 1], g >> 8) AS g FROM s1, t),
s3 AS (SELECT doc_id, block, xor(t[(g & 255) + 1], g >> 8) AS g FROM s2, t), s4 AS (SELECT doc_id, block, xor(t[(g & 255) + 1], g >> 8) % 256 AS g FROM s3, t),
q AS (SELECT doc_id, block, log2(253) - sum(n * log2(n)) / 253 AS h4 FROM (SELECT doc_id, block, g, count(*) AS n FROM s4 GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, block::INT AS block, floor(h1 * 16 + 0.5)::INT AS h1_q4, floor(CASE WHEN h1 >= 7.875 AND runs IS NULL THEN h1 ELSE h4 END * 16 + 0.5)::INT AS h4_q4, coalesce(runs, 0)::INT AS runs, least(255, top) AS top4,
  ((p >= 128)::INT + 2 * (w >= 128)::INT + 4 * (o >= 128)::INT + 8 * (z >= 128)::INT) AS classes FROM h JOIN q USING (doc_id, block) LEFT JOIN r USING (doc_id, block)""")
def block_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(fc.block_fingerprints(text_bytes())).alias("b"))
    return d.select("doc_id", "b.*")


@query("""WITH t AS (SELECT page_id, ltrim(html, ' ' || chr(9) || chr(10) || chr(13)) AS l, html FROM pages)
SELECT page_id, CASE WHEN l = '' THEN 'Unknown' WHEN l[1] IN ('{', '[') THEN 'Json' WHEN l[1] = '<' THEN 'Xml' WHEN octet_length(encode(html)) = length(html) THEN 'AsciiText' ELSE 'Utf8Text' END AS format,
  CASE WHEN l = '' THEN 'unk' ELSE 'txt' END AS category, true AS compressible FROM t""")
def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", fc.detect_format(fc.utf8("html")).alias("f"))
    f = F.col("f.format")
    return d.select("page_id", f.alias("format"), fc.category(f).alias("category"), fc.is_compressible(f).alias("compressible"))


@query("""SELECT doc_id, ((octet_length(encode(text)) - octet_length(encode(replace(text, 'the', '')))) / 3)::BIGINT AS n, octet_length(encode(substr(text, 1, instr(text, 'the') - 1)))::BIGINT AS first_at
FROM documents WHERE contains(text, 'the')""")
def find_the(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", fc.find_all(text_bytes(), b"the").alias("a"), fc.find_bytes(text_bytes(), b"the", "shift_or").alias("first_at"))
    return d.select("doc_id", F.size("a").cast("long").alias("n"), "first_at")


@query("""SELECT pattern, sum(n)::BIGINT AS hits FROM (SELECT 0 AS pattern, (length(text) - length(replace(text, 'the', ''))) / 3 AS n FROM documents UNION ALL SELECT 1, (length(text) - length(replace(text, 'ing', ''))) / 3 FROM documents
  UNION ALL SELECT 2, length(text) - length(replace(text, '.', '')) FROM documents) GROUP BY pattern""")
def find_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(fc.find_many(text_bytes(), [b"the", b"ing", b"."])).alias("m"))
    return d.groupBy(F.col("m.pattern").alias("pattern")).agg(F.count("*").alias("hits"))


def _hilbert(v: DataFrame) -> DataFrame:
    """The order of whole vectors; shorter ones are as if filled with nulls."""
    dim = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    lanes = F.transform(F.sequence(F.lit(0), F.lit(max(dim, 1) - 1)), lambda i: F.get(F.col("embedding"), i))
    return content.hilbert_order(v, "vec_id", lanes, max(dim, 1))


@query("SELECT count(*) AS n, 0::BIGINT AS low, (count(*) - 1)::BIGINT AS high FROM embeddings")
def hilbert_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order is a permutation; tests hold its keys against a plain transform."""
    o = _hilbert(table(spark, sf_dir, "embeddings"))
    return o.agg(F.countDistinct("new_id").alias("n"), F.min("new_id").alias("low"), F.max("new_id").alias("high"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query()
def rcm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.large_graph_order(_edges(spark, sf_dir), "rcm")


@query()
def community_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.large_graph_order(_edges(spark, sf_dir), "community")


# Streams -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events as a stream, drained once."""
    from bytelens.streaming import sketches as st

    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    st.run_once(st.windowed_counts(st.stream_table(spark, sf_dir, "events")), "complete", f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
