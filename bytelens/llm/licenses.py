"""License scans by an exact set-similarity join of text blocks with templates.

A template is a set of tokens. A block, a run of words of a length that the template fixes, matches if it holds the
needed share of the template's tokens. Tokens are ordered by their frequency in the whole corpus, rarest first: a
block that holds ``need`` of a template's t tokens must hold one of the t - need + 1 rarest, its prefix. So only
words of prefixes are looked for; around each, a bound by position in the order and by length drops blocks that
can't reach the need, and the rest are counted exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelens.session import ship


@dataclass(frozen=True)
class Template:
    """label, text, share of tokens that a block must hold, and whether they must stand as in the text."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False
    slack: float = 1.5

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), self.text)))

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.words))

    @property
    def need(self) -> int:
        return math.ceil(self.share * len(self.tokens) - 1e-9)

    @property
    def width(self) -> int:
        return len(self.words) if self.phrase else math.ceil(self.slack * len(self.words))


# Phrases and labels of the base, and the sentences by which public licenses are declared.
BASE = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)
DECLARATIONS = (
    Template("apache", "licensed under the apache license version 2 0", 0.85),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by", "this work is licensed under a creative commons attribution license", 0.8),
    Template("cc-by", "licensed under cc by 4 0", 0.8),
    Template("gpl", "this work is licensed under the gnu general public license version 3", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("mit", "released under the mit license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("reserved", "copyright all rights reserved", 1.0),
)


@dataclass
class _Plan:
    """What executors need: vocabulary in frequency order, and for each template its token numbers in that order."""

    templates: tuple[Template, ...]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sets: list[np.ndarray] = field(default_factory=list)
    seqs: list[np.ndarray] = field(default_factory=list)
    prefix: list[np.ndarray] = field(default_factory=list)


def _counter(hashes: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.words import ALNUM, words

        for batch in batches:
            n = np.zeros(len(hashes), np.int64)
            for w in words(batch.column("_text"), ALNUM):
                at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                n += np.bincount(at[hashes[at] == w.hash], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes)), pa.int64()), pa.array(n)], ["token", "n"])

    return count


def plan(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> _Plan:
    """Order the templates' tokens by how often each stands in all texts."""
    from bytelens.llm.words import word_hash

    ship(docs.sparkSession)
    vocabulary = sorted({t for x in templates for t in x.tokens})
    raw = np.array([word_hash(t) for t in vocabulary], np.uint64)
    order = np.argsort(raw)
    names, hashes = [vocabulary[i] for i in order], raw[order]
    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(_counter(hashes), "token long, n long")
    n = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # the templates' tokens only
    rank = {names[i]: k for k, i in enumerate(sorted(range(len(names)), key=lambda i: (n.get(i, 0), names[i])))}
    p = _Plan(templates, hashes, np.array([rank[x] for x in names], np.int64))
    for t in templates:
        own = np.array(sorted(rank[x] for x in t.tokens), np.int64)
        p.sets.append(own)
        p.seqs.append(np.array([rank[x] for x in t.words], np.int64))
        p.prefix.append(own[: len(own) - t.need + 1])
    return p


def _phrase_places(at: np.ndarray, tok: np.ndarray, seq: np.ndarray) -> list[int]:
    place = dict(zip(at.tolist(), tok.tolist(), strict=True))
    return [p for p in at[tok == seq[0]].tolist() if all(place.get(p + i) == s for i, s in enumerate(seq.tolist()))]


def blocks(at: np.ndarray, tok: np.ndarray, own: np.ndarray, prefix: np.ndarray, need: int, width: int) -> list[tuple[int, int, float]]:
    """Maximal stretches of matching blocks of one document: (first word, last word, best share).

    at, tok: places and numbers of vocabulary words. A block starts at a token of the template and has ``width`` words.
    """
    mine = np.isin(tok, own)
    at, tok = at[mine], tok[mine]
    if len(at) < need:
        return []
    # By position: the rarest token of a matching block is a hit, and what stands behind it in the order must make up the need.
    hits = []
    for a, t in zip(at[in_prefix := np.isin(tok, prefix)].tolist(), tok[in_prefix].tolist(), strict=True):
        lo, hi = np.searchsorted(at, (a - width + 1, a + width))
        if len(np.unique(tok[lo:hi][tok[lo:hi] >= t])) >= need:
            hits.append(a)
    if not hits:
        return []
    hits = np.array(hits)
    # Only tokens within a block's reach of a prefix token can be in a matching block.
    k = np.searchsorted(hits, at)
    near = np.minimum(np.abs(at - hits[np.minimum(k, len(hits) - 1)]), np.abs(at - hits[np.maximum(k - 1, 0)])) < width
    at, tok = at[near].tolist(), tok[near].tolist()
    out: list[list] = []
    count: dict[int, int] = {}
    j = 0
    for i, a in enumerate(at):
        while j < len(at) and at[j] < a + width:
            count[tok[j]] = count.get(tok[j], 0) + 1
            j += 1
        if len(count) >= need:
            share = len(count) / len(own)
            last = at[j - 1]
            if out and a <= out[-1][1]:
                out[-1][1], out[-1][2] = max(out[-1][1], last), max(out[-1][2], share)
            else:
                out.append([a, last, share])
        count[tok[i]] -= 1
        if not count[tok[i]]:
            del count[tok[i]]
    return [tuple(x) for x in out]


def _scanner(p: _Plan):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelens.llm.words import ALNUM, words

        kind = pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
        rare = np.zeros(len(p.hashes), bool)
        if p.prefix:
            rare[np.unique(np.concatenate(p.prefix))] = True
        for batch in batches:
            for w in words(batch.column("_text"), ALNUM):
                found = np.minimum(np.searchsorted(p.hashes, w.hash), len(p.hashes) - 1)
                known = np.flatnonzero(p.hashes[found] == w.hash)
                tok = p.number[found[known]]
                ends = np.searchsorted(known, w.ends)
                some = np.add.reduceat(np.append(rare[tok], 0), np.minimum(ends[:-1], len(tok))) * (np.diff(ends) > 0)
                out = []
                for k in range(w.last - w.first):
                    rows: list = []
                    if some[k]:
                        a, b = ends[k], ends[k + 1]
                        at, t = known[a:b] - w.ends[k], tok[a:b]
                        for x, tmpl in enumerate(p.templates):
                            if not np.isin(t, p.prefix[x]).any():
                                continue
                            if tmpl.phrase:
                                rows += [(x, q, q + len(p.seqs[x]) - 1, 1.0) for q in _phrase_places(at, t, p.seqs[x])]
                            else:
                                rows += [(x, f, g, s) for f, g, s in blocks(at, t, p.sets[x], p.prefix[x], tmpl.need, tmpl.width)]
                    out.append([{"template": x, "first": f, "last": g, "share": s} for x, f, g, s in rows])
                n = w.last - w.first
                cols = {c: batch.column(c).slice(w.first, n) for c in batch.schema.names if c != "_text"}
                cols |= {"n_words": pa.array(np.diff(w.ends), pa.int64()), "blocks": pa.array(out, kind)}
                yield pa.RecordBatch.from_pydict(cols)

    return scan


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + DECLARATIONS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, blocks) for every row; blocks: array of (template number, first word, last word, share).

    Every whole text, however long, is read twice: for the frequencies, then for the blocks. A-Z count as lower case; words are
    runs of ASCII letters and digits and of all that isn't ASCII. Null and empty texts have no words and no blocks;
    overlapping blocks of one template are one; extra columns are ignored; no rows give none.
    """
    p = plan(docs, templates, text_col)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scanner(p), f"`{id_col}` {kind}, n_words long, blocks array<struct<template:int,first:bigint,last:bigint,share:double>>")
