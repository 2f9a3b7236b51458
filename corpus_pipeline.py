"""A corpus from `documents`: toxic ones go, repeated lines go, one of each group of near-duplicates stays, sources are
mixed to their weights, and what is left is packed into sequences.

Each stage gets all that the one before kept and is written as Parquet in the shared folder. In every stage null texts
count as empty, empty tables give no rows, texts of any length are read whole, and further columns, whatever their
names, are passed on unchanged. Each stage has the session send texts to Python in batches of 8 MB at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.llm.line_dedup import dedup_lines
from bytelens.llm.minhash import near_duplicates
from bytelens.llm.mixing import mixed_documents
from bytelens.llm.packing import pack_documents
from bytelens.llm.scratch import Scratch
from bytelens.llm.toxicity import fit, scores
from bytelens.session import ship

#: Which documents survive depends on a trained model and on draws, so SQL can't say it; tests/llm hold each stage.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7. Labels of a third of the ids, by hash, are left out of the fit.

    Every row is scored by its own text, so repeated rows go or stay together. Without labels none goes.
    """
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    ship(spark)
    score = scores(fit(docs.select("doc_id", "text"), labels.where(~out)))
    return docs.where(score(F.col("text")) < 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; n_chars follows the text.

    Every row stays, if with an empty text; rows that are equal in id and text are one document and keep equal texts.
    """
    _small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return d.select(*[n.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    A row is named by a hash of its id and text, so rows that share an id and not their text are documents of their own.
    Of rows equal in both the least stays. Texts without words are copies of nothing and all stay.
    """
    _small_batches(spark)
    key = _unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), scratch=Scratch(spark))
    kept = found.where("kept AND n_shingles > 0").select(F.col("doc_id").alias(key)).distinct()
    rows = keyed.join(kept.hint("shuffle_hash"), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))).alias("row"))
    no_words = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.select("row.*").union(docs.where(no_words))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; documents without words are not taken."""
    _small_batches(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and place; repeated rows are packed each."""
    _small_batches(spark)
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        new = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = new
    return STAGES[-1][1](spark, docs, sf_dir)
