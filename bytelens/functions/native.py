"""Functions built from Spark's own expressions alone: of count arrays, vectors, sets and packed bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _same(a: Column, b: Column, c: Column) -> Column:
    """c, or null where the arrays differ in length."""
    return F.when(F.size(a) == F.size(b), c)


def shares(counts: Column) -> Column:
    """Of a total; all zero where the total is."""
    # The array and its total go through as one value: a lambda may not hold what is computed outside the JVM.
    one = F.array(F.struct(counts.alias("c"), _sum(F.transform(counts, lambda x: x.cast("double"))).alias("t")))
    return F.flatten(F.transform(one, lambda s: F.transform(s["c"], lambda x: F.when(s["t"] == 0, 0.0).otherwise(x / s["t"]))))


def entropy(counts: Column) -> Column:
    return F.greatest(F.lit(0.0), -_sum(F.transform(shares(counts), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))) + 0.0


def min_entropy(counts: Column) -> Column:
    top = F.array_max(shares(counts))
    return F.when(top > 0, F.greatest(F.lit(0.0), -F.log2(top)) + 0.0).otherwise(0.0)


def renyi(counts: Column, alpha: float) -> Column:
    """Null for alpha of 0 and less, and of 1; 0 for no counts."""
    if alpha <= 0 or abs(alpha - 1) < 1e-12:
        return F.when(_sum(F.transform(counts, lambda x: x.cast("double"))) == 0, 0.0)
    s = _sum(F.transform(shares(counts), lambda p: F.when(p > 0, F.pow(p, F.lit(alpha))).otherwise(0.0)))
    return F.when(s > 0, F.greatest(F.lit(0.0), F.log2(s) / (1 - alpha))).otherwise(0.0)


def top_coverage(counts: Column, k: int) -> Column:
    return _sum(F.slice(F.sort_array(shares(counts), asc=False), 1, min(k, 32)))


def concentration(counts: Column) -> Column:
    return F.array_max(shares(counts))


def _both(a: Column, b: Column, f) -> Column:
    return _same(a, b, _sum(F.zip_with(shares(a), shares(b), f)))


def total_variation(a: Column, b: Column) -> Column:
    return _both(a, b, lambda p, q: F.abs(p - q)) / 2


def kolmogorov_smirnov(a: Column, b: Column) -> Column:
    """Largest gap between the running sums, in the order of the bins."""
    gaps = F.zip_with(shares(a), shares(b), lambda p, q: p - q)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("top"))
    step = lambda s, x: F.struct((s["run"] + x).alias("run"), F.greatest(s["top"], F.abs(s["run"] + x)).alias("top"))
    return _same(a, b, F.aggregate(gaps, start, step, lambda s: s["top"]))


def _smooth(counts: Column, by: float) -> Column:
    return shares(F.transform(counts, lambda x: x + F.lit(float(by)))) if by else shares(counts)


def kullback_leibler(a: Column, b: Column, smoothing: float = 0.0) -> Column:
    """In nats; infinite where only b lacks a bin, null for a negative smoothing."""
    if smoothing < 0:
        return F.lit(None).cast("double")
    term = lambda p, q: F.when(p == 0, 0.0).when(q == 0, F.lit(float("inf"))).otherwise(p * F.ln(p / q))
    return _same(a, b, F.greatest(F.lit(0.0), _sum(F.zip_with(_smooth(a, smoothing), _smooth(b, smoothing), term))))


def jensen_shannon(a: Column, b: Column, smoothing: float = 0.5) -> Column:
    """The distance, in nats."""
    if smoothing < 0:
        return F.lit(None).cast("double")
    half = lambda p, q: F.when(p == 0, 0.0).otherwise(p * F.ln(2 * p / (p + q)))
    s = _sum(F.zip_with(_smooth(a, smoothing), _smooth(b, smoothing), lambda p, q: half(p, q) + half(q, p)))
    return _same(a, b, F.sqrt(F.greatest(F.lit(0.0), s / 2)))


def hellinger(a: Column, b: Column) -> Column:
    return F.sqrt(_both(a, b, lambda p, q: F.pow(F.sqrt(p) - F.sqrt(q), 2)) / 2)


def triangular(a: Column, b: Column) -> Column:
    return _both(a, b, lambda p, q: F.when(p + q > 0, F.pow(p - q, 2) / (p + q)).otherwise(0.0))


def l2_counts(a: Column, b: Column, normalized: bool = False) -> Column:
    x, y = (shares(a), shares(b)) if normalized else (a, b)
    return _same(a, b, F.sqrt(_sum(F.zip_with(x, y, lambda p, q: F.pow((p - q).cast("double"), 2)))))


def cosine_counts(a: Column, b: Column) -> Column:
    """A distance: 0 if both are empty, 1 if one is."""
    x, y = dot(a, a), dot(b, b)
    d = 1 - dot(a, b) / F.sqrt(x * y)
    return _same(a, b, F.when((x == 0) & (y == 0), 0.0).when((x == 0) | (y == 0), 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), d))))


DISTANCES = {
    "total_variation": total_variation,
    "kolmogorov_smirnov": kolmogorov_smirnov,
    "kullback_leibler": lambda a, b: kullback_leibler(a, b, 0.5),
    "jensen_shannon": jensen_shannon,
    "hellinger": hellinger,
    "triangular": triangular,
    "l2": l2_counts,
    "l2_normalized": lambda a, b: l2_counts(a, b, normalized=True),
    "cosine": cosine_counts,
}


def count_distance(name: str, a: Column, b: Column) -> Column:
    """A distance of two arrays of counts by its name in ``DISTANCES``; by name the cosine distance of two empty ones is 1."""
    d = DISTANCES[name](a, b)
    return F.when((dot(a, a) == 0) & (dot(b, b) == 0), 1.0).otherwise(d) if name == "cosine" else d


def count_distances(a: Column, b: Column) -> Column:
    """All of ``DISTANCES`` in one struct."""
    return F.struct(*[f(a, b).alias(k) for k, f in DISTANCES.items()])


# Predicates on what columns.structure and columns.extent_fingerprint give ------------------------


def is_zero_filled(structure: Column) -> Column:
    """Not empty, and zero throughout."""
    return (structure["total"] > 0) & (structure["zeros"] == structure["total"])


def is_sparse(structure: Column) -> Column:
    return (structure["total"] > 0) & (structure["zeros"] * 100 >= 95 * structure["total"])


def is_low_cardinality(structure: Column) -> Column:
    return (structure["total"] > 0) & (structure["distinct"] <= 16)


def is_text_like(structure: Column) -> Column:
    return (structure["total"] > 0) & ((structure["whitespace"] + structure["printable"]) * 10 >= 9 * structure["total"])


def skips_compression(fingerprint: Column) -> Column:
    """Nearly uniform bytes and hardly any runs: compressing would gain nothing."""
    return (fingerprint["h1"] >= 7.90) & (fingerprint["rl_fraction"] < 0.01)


# Vectors ----------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def dot_wrapped(a: Column, b: Column) -> Column:
    """Of arrays of unsigned 32-bit numbers, modulo 2^32."""
    part = lambda x, y: ((x.cast("long") * y.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))) + ((x.cast("long") * F.shiftright(y.cast("long"), 16)).bitwiseAND(F.lit(0xFFFF).cast("long"))) * 65536).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return _same(a, b, F.aggregate(F.zip_with(a, b, part), F.lit(0).cast("long"), lambda s, x: (s + x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def dot_checked(a: Column, b: Column) -> Column:
    """Of arrays of unsigned 32-bit numbers; null where the sum passes 2^32 - 1."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("decimal(20,0)") * y.cast("decimal(10,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return _same(a, b, F.when(s <= 0xFFFFFFFF, s.cast("long")))


def l2_squared(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def l1(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return _same(a, b, F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def hamming(a: Column, b: Column) -> Column:
    """Of arrays of 64-bit words."""
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))


def jaccard_bits(a: Column, b: Column) -> Column:
    """1 where both are empty."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, x: s + x)
    both, either = count(lambda x, y: F.bit_count(x.bitwiseAND(y))), count(lambda x, y: F.bit_count(x.bitwiseOR(y)))
    return _same(a, b, F.when(either == 0, 1.0).otherwise(both / either))


def sign_words(v: Column) -> Column:
    """A bit for each component above 0, 64 to a word, lowest first."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    one = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.transform(words, lambda w: F.aggregate(F.transform(F.slice(v, w * 64 + 1, F.lit(64)), one), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def simhash_cosine(a: Column, b: Column) -> Column:
    return F.cos(F.lit(3.141592653589793) * F.bit_count(a.bitwiseXOR(b)) / 64)


# Sets -------------------------------------------------------------------------------------------


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def contains_each(haystack: Column, needles: Column) -> Column:
    return F.transform(needles, lambda n: F.array_contains(haystack, n))


def jaccard_sets(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def gaps(sorted_values: Column) -> Column:
    return F.transform(sorted_values, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(sorted_values, i)))


def varint_len(v: Column) -> Column:
    """Bytes of the unsigned LEB128 form of a number from 0."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7))


def undelta(gaps: Column) -> Column:
    """The values whose gaps these are: running sums."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("v"))
    step = lambda a, g: F.struct((a["s"] + g).alias("s"), F.array_append(a["v"], a["s"] + g).alias("v"))
    return F.when(gaps.isNotNull(), F.aggregate(gaps, start, step, lambda a: a["v"]))


def conditional_entropy(pairs: Column) -> Column:
    """Bits of the next byte given the one before, from the 65,536 counts of pairs, the first byte lowest; 0 of none."""
    first = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(255)), F.lit(0).cast("long"), lambda s, j: s + F.get(pairs, j * 256 + i)))
    return F.greatest(F.lit(0.0), entropy(pairs) - entropy(first))


def bloom_rate(items: Column, bits: int, hashes: int) -> Column:
    """The share of other items that a filter of this shape with so many in it takes for its own."""
    return F.when(items > 0, F.pow(1 - F.exp(-items * float(hashes) / float(bits)), F.lit(float(hashes)))).otherwise(F.when(items.isNotNull(), F.lit(0.0)))
