"""Sliding windows of payloads and of word lists, and predicates, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strided(payload: Column, width: int, stride: int) -> Column:
    """An array of the windows of ``width`` bytes every ``stride``; no partial tail; none for a width or stride of 0."""
    empty = F.array().cast("array<binary>")
    if width < 1 or stride < 1:
        return F.when(payload.isNotNull(), empty)
    last = F.length(payload) - width
    at = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(payload.isNull(), None).when(last < 0, empty).otherwise(F.transform(at, lambda i: F.substring(payload, i + 1, F.lit(width))))


def ngrams(payload: Column, n: int) -> Column:
    return strided(payload, n, 1)


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none for fewer words."""
    last = F.size(words) - n + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def pack_le(window: Column, n: int) -> Column:
    """The long of up to eight bytes, the first lowest."""
    out = F.lit(0).cast("long")
    for i in range(n):
        byte = F.conv(F.hex(F.substring(window, i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def is_zero_page(payload: Column) -> Column:
    """Not empty, and zero throughout."""
    return (F.length(payload) > 0) & (F.length(F.rtrim(F.hex(payload), F.lit("0"))) == 0)


def repeats_every(payload: Column, period: int) -> Column:
    """Whether the first ``period`` bytes, over and over, are the payload, which is longer."""
    n = F.length(payload)
    h = F.hex(payload)
    return (n > period) & (n % period == 0) & (F.repeat(F.substring(h, 1, 2 * period), (n / period).cast("int")) == h)


def repeated_period(payload: Column) -> Column:
    """The least power of two up to 4,096 that the payload repeats with; null if none."""
    return F.coalesce(*[F.when(repeats_every(payload, 1 << k), F.lit(1 << k)) for k in range(13)])
