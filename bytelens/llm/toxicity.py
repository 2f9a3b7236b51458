"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and the beginnings of its words, hashed into 2^BITS buckets. The machine adds a
weight for every term that a text has and, for every pair of them, the product of the two terms' vectors; so a pair can
mean what neither term does alone.

Terms enter in rounds. In the first, those that go with the label more or less often than chance allows; in each later
one, those that do so among the texts that the machine of the round before gets wrong. A term that matters only in a
pair says little over all texts, where most of label 1 has other reasons, but stands out once those are explained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch
from bytelens.session import ship

BITS = 20


@dataclass
class Machine:
    """terms: sorted hashes; weight (n,); vectors (n, k); bias."""

    terms: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts; text rows[i] has term number terms[i]."""
        z = self.bias + np.bincount(rows, self.weight[terms], minlength=n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[terms, f]
            z += 0.5 * (np.bincount(rows, v, minlength=n) ** 2 - np.bincount(rows, v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: np.ndarray, terms: np.ndarray, label: np.ndarray, names: np.ndarray, *, factors: int = 4, steps: int = 300, rate: float = 0.05, ridge: float = 2e-4, seed: int = 5) -> Machine:
    """Fit on texts whose term numbers are given as pairs; Adam on the mean logistic loss."""
    n, m = len(label), len(names)
    if n == 0 or m == 0 or label.min() == label.max():
        share = float(label.mean()) if n else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(names[:0], np.zeros(0), np.zeros((0, factors)), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    share = label.mean()
    w = np.zeros((m, 1 + factors))
    w[:, 1:] = rng.normal(0, 0.05, (m, factors))
    b = float(np.log(share / (1 - share)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    b1 = b2 = 0.0
    # A rare label weighs as much as the common one, so its texts decide as much of the fit.
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    for t in range(1, steps + 1):
        sums = np.stack([np.bincount(rows, w[terms, f], minlength=n) for f in range(1 + factors)], 1)
        squares = np.stack([np.bincount(rows, w[terms, f] ** 2, minlength=n) for f in range(1, 1 + factors)], 1)
        z = b + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        grad = np.empty_like(w)
        grad[:, 0] = np.bincount(terms, g[rows], minlength=m)
        for f in range(1, 1 + factors):
            grad[:, f] = np.bincount(terms, g[rows] * (sums[rows, f] - w[terms, f]), minlength=m)
        grad += ridge * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
        b -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    return Machine(names, w[:, 0].copy(), w[:, 1:].copy(), b)


def _terms(w, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(document of the slice, bucket) of each word and beginning."""
    doc = np.repeat(np.arange(w.last - w.first), np.diff(w.ends))
    docs, terms = [doc], [w.hash]
    for p in prefixes:
        long = w.stop - w.start > p
        docs.append(doc[long])
        terms.append((w.prefix(p) ^ np.uint64(p * 0x9E3779B97F4A7C15 % (1 << 64)))[long])
    return np.concatenate(docs), (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int32)


def _distinct(d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((d.astype(np.int64) << 32) | t)
    return both >> 32, both & 0xFFFFFFFF


def _known(d: np.ndarray, t: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(names):
        return d[:0], np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, t), len(names) - 1)
    hit = names[at] == t
    return _distinct(d[hit], at[hit])


def _lists(d: np.ndarray, t: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), pa.array(t, pa.int32()))


def _hasher(prefixes: tuple[int, ...]):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.tidy import tidy
        from bytelens.llm.words import ALNUM, words

        for batch in batches:
            for w in words(batch.column("_text"), ALNUM):
                n = w.last - w.first
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.first, n), batch.column("toxic").slice(w.first, n), _lists(*_distinct(*_terms(w, prefixes)), n)], ["doc_id", "toxic", "terms"])
        tidy()

    return hashed


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), lists.flatten().to_numpy(zero_copy_only=False)


def _deviator(ids: np.ndarray, expected: np.ndarray):
    """Sums over the texts of each term: their number, label less expectation, and the variance that chance allows."""

    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = expected[np.searchsorted(ids, batch.column("doc_id").to_numpy())]
            rest = batch.column("toxic").to_numpy() - q
            d, t = _flat(batch.column("terms"))
            names, at = np.unique(t, return_inverse=True)
            sums = [np.bincount(at).astype(float), np.bincount(at, rest[d]), np.bincount(at, (q * (1 - q))[d])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *map(pa.array, sums)], ["term", "n", "dev", "var"])

    return deviations


def _picker(names: np.ndarray):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), _lists(*_known(*_flat(batch.column("terms")), names), batch.num_rows)], ["doc_id", "toxic", "terms"])

    return pick


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, prefixes: tuple[int, ...] = (4, 5, 6), least: int = 8, deviations: float = 4.5, terms: int = 8192, rounds: int = 3, scratch: Scratch | None = None, **training) -> Machine:
    """Fit on at most ``sample`` labelled documents, those whose ids have the smallest hashes.

    A round adds terms that stand in ``least`` documents and whose labels differ from what the last machine expects by
    four documents at least and that many ``deviations``; of more than ``terms`` a round, those that differ most. Rounds end
    when no term is new, after ``rounds`` at the latest. These bounds hold for the fit alone. Labels of null or
    without a document count for nothing; of repeated labels the largest counts, of rows that share an id the greatest text.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    once = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("_text").alias("_text"))  # bounded by `sample`
    own = scratch.save(once.mapInArrow(_hasher(prefixes), "doc_id long, toxic int, terms array<int>"))
    known = own.select("doc_id", "toxic").toPandas().sort_values("doc_id")
    ids, label = known["doc_id"].to_numpy(np.int64), known["toxic"].to_numpy(float)
    expected = np.full(len(ids), label.mean() if len(ids) else 0.0)
    names, machine = np.zeros(0, np.int64), None
    for _ in range(rounds):
        sums = own.mapInArrow(_deviator(ids, expected), "term int, n double, dev double, var double").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "dev", "var")])
        z = F.abs("dev") / F.sqrt(F.greatest("var", F.lit(1e-9)))
        top = sums.withColumn("z", z).where((F.col("n") >= least) & (F.abs("dev") >= 4) & (F.col("z") >= deviations)).orderBy(F.desc("z"), "term").limit(terms)
        found = np.union1d(names, np.array([r["term"] for r in top.select("term").collect()], np.int64))
        if machine is not None and len(found) == len(names):
            break
        names = found
        got = own.mapInArrow(_picker(names), "doc_id long, toxic int, terms array<int>").orderBy("doc_id").toArrow().combine_chunks()
        lists = got["terms"].chunk(0) if got.num_rows else pa.array([], pa.list_(pa.int32()))
        rows, at = _flat(lists)
        machine = train(rows, at, label, names, **training)
        # What share of the texts on either side of the machine's own middle has label 1.
        high = machine.score(rows, at, len(ids)) >= 0.5 if len(machine.terms) else np.zeros(len(ids), bool)
        for side in (high, ~high):
            if side.any():
                expected[side] = label[side].mean()
    return machine if machine is not None else train(np.zeros(0, int), np.zeros(0, int), label, names, **training)


def scores(machine: Machine, *, prefixes: tuple[int, ...] = (4, 5, 6)):
    """A function of a text column that gives its score; null and empty texts get the score of no terms.

    Texts go to Python in one copy and nothing but scores comes back.
    """

    def score(texts: pa.Array) -> pa.Array:
        from bytelens.llm.tidy import tidy
        from bytelens.llm.words import ALNUM, words

        out = [machine.score(*_known(*_terms(w, prefixes), machine.terms), w.last - w.first) for w in words(texts, ALNUM)]
        tidy()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    made = F.arrow_udf(score, "double").asNondeterministic()  # so that no rule has it computed twice
    return lambda text: made(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, machine: Machine, *, prefixes: tuple[int, ...] = (4, 5, 6), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, very long texts whole; extra columns are ignored."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col), scores(machine, prefixes=prefixes)(F.col(text_col)).alias("score"))
