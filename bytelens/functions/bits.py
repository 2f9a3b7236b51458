"""Packed bits as columns: arrays of 64-bit words, lowest bit first, with set operations, ranks and selections.

Null in gives null out. Places outside the bits, and ones or zeros that aren't there, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def bitmap(values: Column, bits: int) -> Column:
    """The words of a set of numbers from 0 to bits - 1; others are left out."""
    word = lambda w: F.aggregate(F.filter(values, lambda v: (v >= w * 64) & (v < (w + 1) * 64) & (v < bits)), _long(0), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", _long(1), F.pmod(v, F.lit(64)).cast("int"))))
    return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(max(1, -(-bits // 64)) - 1)), word))


def members(words: Column) -> Column:
    """The places of the ones, rising."""
    own = lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(w, k) == 1), lambda k: i.cast("long") * 64 + k)
    return F.flatten(F.transform(words, own))


def bit_and(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseXOR(y))


def bit_andnot(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def _each(a: Column, b: Column, f) -> Column:
    """Of bitmaps of one length; null otherwise."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def popcount(words: Column) -> Column:
    return F.when(words.isNotNull(), F.aggregate(words, _long(0), lambda s, w: s + F.bit_count(w)))


def contains(words: Column, place: Column) -> Column:
    w = F.get(words, F.floor(place / 64).cast("int"))
    return F.coalesce(F.getbit(w, F.pmod(place, F.lit(64)).cast("int")) == 1, F.lit(False))


def insert(words: Column, place: Column) -> Column:
    """The words with a one at the place; unchanged where the place is outside."""
    at = F.floor(place / 64)
    bit = F.call_function("shiftleft", _long(1), F.pmod(place, F.lit(64)).cast("int"))
    return F.transform(words, lambda w, i: F.when(i == at, w.bitwiseOR(bit)).otherwise(w))


def remove(words: Column, place: Column) -> Column:
    at = F.floor(place / 64)
    bit = F.call_function("shiftleft", _long(1), F.pmod(place, F.lit(64)).cast("int"))
    return F.transform(words, lambda w, i: F.when(i == at, w.bitwiseAND(F.bitwise_not(bit))).otherwise(w))


def rank1(words: Column, place: Column) -> Column:
    """Ones before the place."""
    full = F.floor(place / 64).cast("int")
    before = F.aggregate(F.slice(words, F.lit(1), F.greatest(F.lit(0), full)), _long(0), lambda s, w: s + F.bit_count(w))
    low = F.pmod(place, F.lit(64)).cast("int")
    mask = F.bitwise_not(F.call_function("shiftleft", _long(-1), low))
    part = F.when(low == 0, _long(0)).otherwise(F.bit_count(F.get(words, full).bitwiseAND(mask)).cast("long"))
    return F.when((place >= 0) & (place <= F.size(words) * 64), before + part)


def rank0(words: Column, place: Column) -> Column:
    """Zeros before the place."""
    return place.cast("long") - rank1(words, place)


def select1(words: Column, k: Column) -> Column:
    """The place of the k-th one, from 0."""
    return F.when(k >= 0, F.get(members(words), k.cast("int")))


def select0(words: Column, k: Column) -> Column:
    """The place of the k-th zero, from 0."""
    return select1(F.transform(words, F.bitwise_not), k)


def ranks(words: Column, places: Column) -> Column:
    """rank1 of each place of an array."""
    return F.transform(places, lambda p: rank1(words, p))


def selects(words: Column, ks: Column) -> Column:
    """select1 of each number of an array."""
    one = F.array(F.struct(members(words).alias("m")))
    return F.flatten(F.transform(one, lambda s: F.transform(ks, lambda k: F.when(k >= 0, F.get(s["m"], k.cast("int"))))))
