"""The registered queries of this subpackage and the SQL that each must equal, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: which documents are rounded up is drawn; tests/llm hold the sums and limits against a plain computation."""
    from bytelens.llm.mixing import mix

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: ids of a tokenizer. tests/llm hold pieces against the library and sequences against their capacities."""
    import public_tokenizers

    from bytelens.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: ids of a tokenizer, from files. tests/llm hold them against the library, the files against a round trip."""
    import public_tokenizers

    from bytelens.llm.scratch import Scratch
    from bytelens.llm.token_store import qualified, read_store, write_store

    scratch = Scratch(spark)
    folder = qualified(spark, scratch.path())
    made = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, drops_space=False, scratch=scratch)
    return read_store(made, folder)


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too slow in SQL on whole tables; tests/llm hold the components against all pairs of a fixture."""
    from bytelens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: a trained model. tests/llm hold its accuracy on documents that it didn't learn from."""
    from bytelens.llm.toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = score(docs, fit(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: random walks. tests/llm hold edited texts, walks and groups against plain computations."""
    from bytelens.llm.edit_fingerprint import edited_and_similar

    return edited_and_similar(table(spark, sf_dir, "documents"))


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM c
), k AS (
  SELECT *, pos = 1 AND role = 'system' AS sys, len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) + 4 AS tok,
    8 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '<<'), '[', '[['), '|', '||'))
      + length(replace(replace(replace(text, '\', '\\'), '<', '<<'), '[', '[[')) AS size FROM n
), b AS (
  SELECT *, sum(CASE WHEN sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY pos) AS stop,
    greatest(1, 384 - sum(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id)) AS room FROM k
), s AS (
  SELECT *, stop - CASE WHEN sys THEN 0 ELSE tok END AS start FROM b
), e AS (
  SELECT *, floor(start / room) AS cell FROM s
), f AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE cell * 2 + CASE WHEN floor((stop - 1) / room) > cell
    AND stop - min(start) OVER (PARTITION BY conv_id, cell) > room THEN 1 ELSE 0 END END AS span FROM e
), g AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) AS win FROM f
), h AS (
  SELECT conv_id, win, min(start) AS at FROM g WHERE NOT sys GROUP BY ALL HAVING win > 1
), again AS (
  SELECT g.conv_id, sum(g.size) AS size FROM g JOIN h ON g.conv_id = h.conv_id
    AND (g.sys OR (g.stop <= h.at AND h.at <= g.start + 128)) GROUP BY ALL
)
SELECT g.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(g.size) + coalesce(any_value(again.size), 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN again ON g.conv_id = again.conv_id GROUP BY g.conv_id
""")
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelens.llm.chat import read_back, windows
    from bytelens.llm.scratch import Scratch

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(Scratch(spark).save(windows(rows, budget=512, history=128)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL for the method's own labels and score; tests/llm hold blocks and base places against plain scans."""
    from bytelens.llm.licenses import BASE, DECLARATIONS, scan

    templates = BASE + DECLARATIONS
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("blocks", lambda b: b["template"] < len(BASE))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda b: labels[b["template"]]))), ",")
    found = scan(table(spark, sf_dir, "documents"), templates)
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["first"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("blocks")).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0)).alias("score"),
    )


@query()
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too slow in SQL on whole tables; tests/llm hold the lines against all runs of a fixture."""
    from bytelens.llm.line_dedup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",")
    return d.select("doc_id", "n_lines", "n_removed", F.coalesce(ranges, F.lit("")).alias("removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query()
def op10_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in SQL are too slow on whole tables; tests/llm hold the links against them on a fixture."""
    from bytelens.llm.embedding_dedup import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


@query()
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL where no rule fits: a trained model. tests/llm hold hosts, paths and rules against a plain computation, and held-out accuracy."""
    from bytelens.llm.url_filter import Rule, judge

    rules = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """docs whose words, in one document of ten by its id's hash, repeat from some word on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("_w")
    start = F.col("_g") % n
    period = 1 + F.floor((n - start) / (3 + F.col("_g") % 8))
    rows = docs.where(h % 10 == 0).select("doc_id", g.cast("long").alias("_g"), words.alias("_w")).where(n > 0).select("doc_id", "_w", start.alias("_a"), period.alias("_p"))
    at = F.sequence(F.lit(0), n - 1)
    made = F.array_join(F.transform(at, lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))), " ")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    other = docs.where(~(F.coalesce(h % 10 == 0, F.lit(False)) & has_words)).select("doc_id", "text")
    return rows.select("doc_id", made.alias("text")).union(other)


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All starts and periods in SQL are too slow on whole tables; tests/llm hold the runs against them on fixtures."""
    from bytelens.llm.periodic_runs import collapse_runs

    found = collapse_runs(repeated_tails(table(spark, sf_dir, "documents")), exponent=4, least=6)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"), F.expr("(1000 * b.l) div (-b.p)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query(r"""
WITH RECURSIVE c AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM c WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8
), r AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL
), b AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)) AS bytes FROM r
), h AS (
  SELECT w, n, xor(list_reduce(bytes, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, tab
), e AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END AS w, n FROM h
), words AS (
  SELECT w, sum(n)::BIGINT AS n FROM e WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5
), d AS (
  SELECT w, i, w[:i - 1] || w[i + 1:] AS rest FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT x.w AS a, y.w AS b FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.w <> y.w
  UNION SELECT d.w, words.w FROM d JOIN words ON d.rest = words.w
  UNION SELECT words.w, d.w FROM d JOIN words ON d.rest = words.w
), best AS (
  SELECT a AS w, count(*) AS n_near, first(struct_pack(b := b, n := words.n) ORDER BY words.n DESC, encode(b)) AS x FROM near JOIN words ON words.w = b GROUP BY a
), f AS (
  SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 5 * words.n THEN x.b END AS form, CASE WHEN x.n >= 5 * words.n THEN x.n END AS form_n
  FROM words LEFT JOIN best ON words.w = best.w
), up AS (
  SELECT w, w AS root, 0 AS k FROM f
  UNION ALL SELECT up.w, f.form, k + 1 FROM up JOIN f ON up.root = f.w WHERE f.form IS NOT NULL
)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN (SELECT w, arg_max(root, k) AS root FROM up GROUP BY w) USING (w)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelens.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), drop_one_in=199)
