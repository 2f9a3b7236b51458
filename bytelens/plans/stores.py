"""Queries over stored structures and streams of pieces, against SQL that computes each result anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.functions import columns as fc
from bytelens.functions.chunking import ChunkSizes
from bytelens.operators import bitvectors, content, neighbours, patterns, postings
from bytelens.plans.registry import ORACLE_SQL, query, table
from bytelens.scratch import Scratch, shared_folder
from bytelens.streaming import pieces as sp
from bytelens.streaming.sketches import run_once

_M = "18446744073709551616::UHUGEINT"
SIZES = ChunkSizes.around(1024, 1)

#: Chunks of documents: the table of the rolling hash, bytes of the texts, and a fold of them that notes each cut.
_CHUNKS = f"""WITH RECURSIVE g AS (
  SELECT -1 AS i, 11400714819323198485::UHUGEINT AS s
  UNION ALL SELECT i + 1, xor(v3, v3 >> 31) FROM (
    SELECT i, (xor(v2, v2 >> 27) * 10723151780598845931::UHUGEINT) % {_M} AS v3 FROM (
      SELECT i, (xor(v1, v1 >> 30) * 13787848793156543929::UHUGEINT) % {_M} AS v2 FROM (
        SELECT i, (s + (i + 1)::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M} AS v1 FROM g WHERE i < 255)))
), t AS (SELECT list(s ORDER BY i) FILTER (i >= 0) AS gear FROM g
), d AS (
  SELECT doc_id, flatten(list_transform(string_split(text, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] WHEN ord(x) < 2048 THEN [192 + ord(x) // 64, 128 + ord(x) % 64]
    WHEN ord(x) < 65536 THEN [224 + ord(x) // 4096, 128 + ord(x) // 64 % 64, 128 + ord(x) % 64]
    ELSE [240 + ord(x) // 262144, 128 + ord(x) // 4096 % 64, 128 + ord(x) // 64 % 64, 128 + ord(x) % 64] END)) AS bytes FROM documents WHERE text <> ''
), u AS (
  SELECT doc_id, len(bytes) AS n, list_transform(bytes, lambda x: {{'h': gear[x + 1], 's': 0::BIGINT, 'p': 0::BIGINT, 'c': []::BIGINT[]}}) AS units FROM d, t
), a AS (
  SELECT doc_id, n, list_reduce(units, lambda a, x: {{
    'h': (a.h * 2 % {_M} + a.h // 9223372036854775808::UHUGEINT + x.h) % {_M}, 'p': a.p + 1,
    's': CASE WHEN a.p + 1 - a.s = {SIZES.max_size} OR (a.p >= a.s + {SIZES.min_size} AND a.p < a.s + {SIZES.avg_size} AND (a.h * 2 % {_M} + a.h // 9223372036854775808::UHUGEINT + x.h) % {SIZES.masks()[0] + 1} = 0)
      OR (a.p >= a.s + {SIZES.avg_size} AND (a.h * 2 % {_M} + a.h // 9223372036854775808::UHUGEINT + x.h) % {SIZES.masks()[1] + 1} = 0) THEN a.p + 1 ELSE a.s END,
    'c': CASE WHEN a.p + 1 - a.s = {SIZES.max_size} OR (a.p >= a.s + {SIZES.min_size} AND a.p < a.s + {SIZES.avg_size} AND (a.h * 2 % {_M} + a.h // 9223372036854775808::UHUGEINT + x.h) % {SIZES.masks()[0] + 1} = 0)
      OR (a.p >= a.s + {SIZES.avg_size} AND (a.h * 2 % {_M} + a.h // 9223372036854775808::UHUGEINT + x.h) % {SIZES.masks()[1] + 1} = 0) THEN list_append(a.c, a.p + 1) ELSE a.c END
  }}, {{'h': 0::UHUGEINT, 's': 0::BIGINT, 'p': 0::BIGINT, 'c': []::BIGINT[]}}) AS z FROM u
), k AS (
  SELECT doc_id, CASE WHEN len(z.c) = 0 OR z.c[-1] < n THEN list_append(z.c, n) ELSE z.c END AS ends FROM a
)
SELECT doc_id, (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END)::BIGINT AS "start", ends[i]::BIGINT AS "end" FROM (SELECT doc_id, ends, unnest(range(1, len(ends) + 1)) AS i FROM k)"""


#: Of the catalog's query: what each distinct chunk costs.
ORACLE_SQL["chunk_dedup"] = f"""WITH c AS ({_CHUNKS}), p AS (SELECT sha256(unhex(hex(encode(text))[2 * c."start" + 1:2 * c."end"])) AS digest, c."end" - c."start" AS size FROM c JOIN documents USING (doc_id))
SELECT digest, count(*) AS copies, any_value(size)::BIGINT AS size FROM p GROUP BY digest"""


@query(_CHUNKS)
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content.chunk_rows(table(spark, sf_dir, "documents"), fc.utf8("text"), SIZES, ["doc_id"])
    return c.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _streamed(spark: SparkSession, rows: DataFrame, files: int) -> tuple[DataFrame, str]:
    """rows as a stream of that many files, one for each batch, and a folder for its state and result."""
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def _pieces(d: DataFrame, size: int) -> DataFrame:
    """(key, seq, payload, last): documents cut into pieces of that many bytes; an empty one is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / size)).cast("int")
    d = d.select(F.col("doc_id").alias("key"), fc.utf8(F.coalesce("text", F.lit(""))).alias("raw"))
    cut = d.select("key", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), "raw", n.alias("n"))
    return cut.select("key", F.col("seq").cast("long").alias("seq"), F.substring("raw", F.col("seq") * size + 1, F.lit(size)).alias("payload"), (F.col("seq") == F.col("n") - 1).alias("last"))


@query(_CHUNKS)
def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in pieces of 1,000 bytes that arrive in four batches, in no order."""
    cut = _pieces(table(spark, sf_dir, "documents"), 1000)
    stream, folder = _streamed(spark, cut, 4)
    run_once(sp.running_chunks(stream, SIZES), "append", f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select(F.col("key").alias("doc_id"), "start", "end")


@query("SELECT user_id, count(*) AS pieces, sum(octet_length(encode(coalesce(props, ''))))::BIGINT AS n_bytes, sha256(string_agg(coalesce(props, ''), '' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def streamed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each user's events in order, from pieces that arrive in three batches, in no order."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), seq.cast("long").alias("seq"), fc.utf8("props").alias("payload"))
    stream, folder = _streamed(spark, rows, 3)
    out = sp.running_digests(stream).select("key", "pieces", "n_bytes", F.lower(F.hex("digest")).alias("digest"))
    sink = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out")
    out.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("key").agg(F.max_by(F.struct("n_bytes", "digest"), "pieces").alias("x"), F.max("pieces").alias("pieces"))
    return last.select(F.col("key").alias("user_id"), "pieces", "x.n_bytes", "x.digest")


def _status_bits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(orders with status F as bits at their keys, the directory of all of them, written)."""
    o = table(spark, sf_dir, "orders").select(F.lit(0).alias("vector"), F.col("o_orderkey").cast("long").alias("pos"), (F.col("o_orderstatus") == "F").cast("int").alias("bit"))
    return o, Scratch(spark).save(bitvectors.directory(bitvectors.packed_words(o, ["vector"]), ["vector"]))


@query("SELECT o_orderkey AS pos, (sum((o_orderstatus = 'F')::INT) OVER (ORDER BY o_orderkey) - (o_orderstatus = 'F')::INT)::BIGINT AS rank1 FROM orders")
def directory_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, held = _status_bits(spark, sf_dir)
    return bitvectors.rank_of(o.select("vector", "pos"), held, ["vector"]).select("pos", "rank1")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_orderkey AS place FROM orders WHERE o_orderstatus = 'F'")
def directory_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, held = _status_bits(spark, sf_dir)
    asked = bitvectors.rank_of(o.where("bit = 1").select("vector", "pos"), held, ["vector"]).select("vector", F.col("rank1").alias("k"))
    return bitvectors.select_of(asked, held, Scratch(spark).save(bitvectors.samples(held, ["vector"])), ["vector"]).select("k", "place")


@query("SELECT DISTINCT a.l_orderkey AS id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'")
def posting_blocks_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.postings(table(spark, sf_dir, "lineitem"), "l_orderkey", F.array("l_returnflag"))
    return postings.block_all_of(Scratch(spark).save(postings.posting_blocks(index)), ["R", "A"])


@query("""WITH p AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS pattern FROM benchmark)
SELECT pattern, count(*) FILTER (contains(text, pattern)) AS n_documents FROM p, documents GROUP BY pattern""")
def pattern_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word of the benchmark stands, as a part of whatever word: one scan for all of them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    found = patterns.pattern_hits(table(spark, sf_dir, "documents"), fc.utf8("text"), words.select(fc.utf8(F.lower("w")).alias("pattern")))
    return found.select(F.decode("pattern", "UTF-8").alias("pattern"), F.col("n_payloads").alias("n_documents"))


@query("""WITH s AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_orderkey))) AS o FROM lineitem GROUP BY ALL), p AS (SELECT a.k, a.o AS x, coalesce(b.o, []) AS y FROM s a LEFT JOIN s b ON b.k = a.k + 1)
SELECT k AS l_suppkey, len(x)::BIGINT AS n, len(list_intersect(x, y))::BIGINT AS both, len(list_distinct(list_concat(x, y)))::BIGINT AS either, (len(x) - len(list_intersect(x, y)))::BIGINT AS alone,
  (len(x) + len(y) - 2 * len(list_intersect(x, y)))::BIGINT AS one, coalesce(list_sum(list_intersect(x, y)), 0)::BIGINT AS total, true AS sound FROM p""")
def container_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each supplier as a set in containers, merged with the next supplier's."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("o")).select(F.col("l_suppkey").cast("long").alias("k"), fc.container_set(F.col("o").cast("array<bigint>")).alias("x"))
    own = Scratch(spark).save(own)
    none = spark.range(1).select(fc.container_set(F.array().cast("array<bigint>")).alias("none"))
    pairs = own.join(own.select((F.col("k") - 1).alias("k"), F.col("x").alias("y")), "k", "left").crossJoin(F.broadcast(none)).select("k", "x", F.coalesce("y", "none").alias("y"))
    x = F.col("x")
    met = pairs.select(F.col("k").alias("l_suppkey"), fc.container_size(x).alias("n"), fc.container_problem(x).alias("problem"), fc.container_meets(x, F.col("y")).alias("m"))
    sound = F.coalesce("problem", "m.problem").isNull().alias("sound")
    return met.select("l_suppkey", "n", F.col("m.size_and").alias("both"), F.col("m.size_or").alias("either"), F.col("m.size_minus").alias("alone"), F.col("m.size_xor").alias("one"), F.col("m.total_and").alias("total"), sound)


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS total FROM orders GROUP BY ALL")
def container_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each order priority, from one set for each day's orders."""
    from bytelens.operators.sets import union_sets

    days = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.collect_set(F.col("o_custkey").cast("long")).alias("c"))
    one = union_sets(days.select("o_orderpriority", fc.container_set(F.col("c")).alias("c")), ["o_orderpriority"], "c")
    return one.select(F.col("o_orderpriority").alias("priority"), fc.container_size(F.col("c")).alias("n"), F.aggregate(fc.container_members(F.col("c")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


#: Bytes of documents, one a row, as hexadecimal digits.
_BYTES = "WITH d AS (SELECT doc_id, lang, hex(encode(text)) AS x FROM documents WHERE length(text) > 0), b AS (SELECT doc_id, lang, i, x[2 * i - 1:2 * i] AS h FROM (SELECT *, unnest(range(1, length(x) // 2 + 1)) AS i FROM d))"


@query(_BYTES + """, e AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e), r AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS total, count(*) - 1 AS transitions, max(n) AS longest_run, count(*) FILTER (n >= 4) AS runs_ge4, coalesce(sum(n) FILTER (n >= 4), 0)::BIGINT AS bytes_in_runs FROM r GROUP BY doc_id""")
def piece_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of whole documents, folded from pieces of 300 bytes."""
    from bytelens.operators.segments import piece_runs

    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return piece_runs(_pieces(d, 300), fan=16).withColumnRenamed("key", "doc_id")


@query(_BYTES + """, p AS (SELECT doc_id, h || lead(h, 1) OVER w || lead(h, 2) OVER w || lead(h, 3) OVER w AS g FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, g, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY ALL) SELECT doc_id, count(*) AS distinct_grams, sum(n)::BIGINT AS observations, max(n) AS most FROM c GROUP BY doc_id""")
def piece_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of four bytes of whole documents, from pieces of 300 bytes."""
    from bytelens.operators.segments import piece_ngrams

    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return piece_ngrams(_pieces(d, 300), 4).withColumnRenamed("key", "doc_id")


@query()
def community_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: communities of all supplier-part edges by rounds of merges; tests hold their modularity against merging one by one."""
    from bytelens.operators.communities import communities

    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return communities(edges)
