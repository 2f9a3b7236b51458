"""URL filters: rules on hosts and paths, and a classifier for what no rule fits.

The classifier is a logistic regression on hashed character n-grams of host and path, which live in one hash space but
begin and end with marks of their own, so that the same letters in a host and in a path are two terms. A url's terms
count by their share of it: each weighs one over the root of their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.session import ship

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """allow or block the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and the path up to ``?`` or ``#``; both empty where url is null or has no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, the first of equally long ones; nulls where none does."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    out = none
    for r in sorted(rules, key=lambda r: len(r.name)):  # later ones stand outside, so they go first
        fits = (F.concat(F.lit("."), host).endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Classifier:
    """weight: one for each of 2^bits buckets; sizes: of n-grams."""

    weight: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """The probability of label 1 of each url; of the empty one that of no terms."""
        rows, terms = ngrams(host, path, self.sizes, self.bits)
        n = len(host)
        count = np.bincount(rows, minlength=n)
        z = self.bias + np.bincount(rows, self.weight[terms], minlength=n) / np.sqrt(np.maximum(count, 1))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ngrams(host: pa.Array, path: pa.Array, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of bytes of every host and path, repeated ones as often as they stand there."""
    from bytelens.llm.words import mix

    pieces = [x for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True) for x in (b"\x01" + (h or "").encode() + b"\x02", b"\x03" + (p or "").encode() + b"\x04")]
    size = np.array([len(x) for x in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    piece = np.repeat(np.arange(len(pieces)), size)
    rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in sizes:
        m = len(data) - k + 1
        if m <= 0:
            continue
        inside = piece[:m] == piece[k - 1 :]
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + data[j : j + m] + np.uint64(1)
        rows.append((piece[:m] >> 1)[inside])
        terms.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(terms)


def train(rows: np.ndarray, terms: np.ndarray, label: np.ndarray, *, bits: int, sizes: tuple[int, ...], steps: int = 150, rate: float = 0.1, ridge: float = 1e-5) -> Classifier:
    """Minimise the mean logistic loss, either label weighing half, by Adam on all urls at once. One label alone, or none, gives its share."""
    n = len(label)
    share = min(max(float(label.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    if n == 0 or label.min() == label.max():
        return Classifier(np.zeros(1 << bits), float(np.log(share / (1 - share))), bits, sizes)
    names, at = np.unique(terms, return_inverse=True)
    value = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1)))[rows]
    w, b = np.zeros(len(names)), 0.0
    first, second, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / n
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[at] * value, minlength=n)
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        grad = np.bincount(at, g[rows] * value, minlength=len(names)) + ridge * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
        b -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(1 << bits)
    weight[names] = w
    return Classifier(weight, b, bits, sizes)


def _smallest(sample: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t = t.group_by(t.column_names).aggregate([])
            held = t.sort_by([("_h", "ascending"), ("host", "ascending"), ("path", "ascending"), ("label", "ascending")]).slice(0, sample)
        if held is not None:
            yield from held.to_batches()

    return keep


def fit(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", sample: int = 4096, sizes: tuple[int, ...] = (3, 4, 5), bits: int = 18, **training) -> Classifier:
    """Fit on at most ``sample`` distinct labelled urls (host, path and label), those with the smallest hashes.

    Each task keeps its ``sample`` smallest, so a url that a third of all rows has counts once and nothing else moves.
    Null labels and null urls count for nothing. label is 0 or 1.
    """
    ship(labelled.sparkSession)
    host, path = host_and_path(F.col(url_col))
    known = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("int").alias("label"))
    hashed = known.select(F.xxhash64("host", "path").alias("_h"), "host", "path", "label")
    few = hashed.mapInArrow(_smallest(sample), "_h long, host string, path string, label int").distinct()
    own = few.orderBy("_h", "host", "path", "label").limit(sample).toArrow().combine_chunks()
    rows, terms = ngrams(own["host"], own["path"], sizes, bits)
    return train(rows, terms, own["label"].to_numpy().astype(float), bits=bits, sizes=sizes, **training)


def scores(model: Classifier):
    """A function of host and path columns that gives the probability of label 1."""

    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array(model.score(host, path))

    return F.arrow_udf(score, "double")


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, *, url_col: str = "url", threshold: float = 0.5, **options) -> DataFrame:
    """pages with host, path, rule, score and verdict in a struct column ``judged``: the longest rule's verdict, else the classifier's.

    labelled: (url, label 0 or 1, 1 to block), the table that the classifier learns from; left out, it is the urls of
    pages that rules judge, of which ``fit`` takes a bounded sample. A url blocks from ``threshold`` on. Null urls and urls
    without ``://`` have an empty host and path, which no rule fits. Every row is kept, repeated ones too; other columns
    pass unchanged, whatever their names. No pages give none.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(f"`{url_col}`"))
    if labelled is None:
        by_rule = fitting_rule(host, path, rules)["verdict"]
        labelled = pages.select(F.col(f"`{url_col}`").alias("url"), (by_rule == "block").cast("int").alias("label"))
    score = scores(fit(labelled, **options))
    rule = fitting_rule(host, path, rules)
    p = score(host, path)
    verdict = F.coalesce(rule["verdict"], F.when(p >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return pages.select("*", F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), p.alias("score"), verdict.alias("verdict")).alias("judged"))
