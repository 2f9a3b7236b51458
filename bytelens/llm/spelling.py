"""Grouping spelling variants: words one edit apart, found by bands of letter parities.

A word's mask has a bit for each class of letters: whether the word has an odd number of them. Inserting or deleting
a letter flips one bit, replacing one flips two at most. So of a mask's three bands one at least is equal in
two words that are one edit apart. Such words are also equal in their first half or in their last one, by the length
of the shorter: an edit lies in one of the halves. Both together are the key of the join, so a bucket stays small
however many words there are; pairs in it are checked by the masks' bits and verified letter by letter inside the
join, which puts out near pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelens.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The letters a to z by how often they stand in European texts, dealt to three bands in turn; others by code point.
_ORDER = "eianrtsoludcmpghbvfykzwqjx"
BAND_BITS = 20


def _lower(word: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = ~word.rlike("[^\x00-\x7f]")
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def corpus_words(docs: DataFrame, *, least_chars: int = 6, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word): every maximal run of letters of at least ``least_chars``, A-Z lower-cased, as often as it stands in the texts.

    drop_one_in: of runs whose crc32 of ``<id>:<run>`` it divides, the letter at that number modulo the length is
    deleted. Rows without an id lose none. Null and empty texts have no words.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    words = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(runs).alias("word")).select("_id", _lower(F.col("word")).alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat(F.col("_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("_h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        hit = F.coalesce(F.col("_h") % drop_one_in == 0, F.lit(False))
        words = words.withColumn("_h", h).select(F.when(hit, cut).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= least_chars)
    return words.select("word")


def parity_mask(word: Column) -> Column:
    """Three bands of BAND_BITS bits each, in one long: which classes of letters have an odd number in the word."""
    place = {c: 1 << (i % 3 * BAND_BITS + i // 3) for i, c in enumerate(_ORDER)}
    known = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    free = BAND_BITS - (len(_ORDER) + 2) // 3
    # Other letters share what bits are left, by code point.
    place_of = lambda c: (F.ascii(c) % 3) * BAND_BITS + (BAND_BITS - free) + F.floor(F.ascii(c) / 3) % free
    other = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place_of(c).cast("int"))
    bit = lambda c: F.coalesce(F.try_element_at(known, c), other(c)).cast("long")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc.bitwiseXOR(bit(c))))


def band(mask: Column, k: int) -> Column:
    return F.shiftright(mask, k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1).cast("long"))


def _half(word: Column, shorter: Column, side: int) -> Column:
    """The half of a word that an edit in the other half leaves alone, where the shorter of the two words has so many letters."""
    head = F.floor(shorter / 2).cast("int")
    return F.substring(word, F.lit(1), head) if side == 0 else F.right(word, shorter - head)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct words of one edit, each once, a being the shorter, or the smaller of equally long ones.

    words: (word, ...), distinct, none empty. An edit inserts, deletes or replaces one code point.
    """
    n = F.length("word")
    w = words.select("word", parity_mask(F.col("word")).alias("mask"), n.alias("n"))

    def keyed(longer: tuple[int, ...], word: str, mask: str) -> DataFrame:
        """A row for each band, half and role: the word itself as the shorter one, or as one that is longer by one."""
        keys = []
        for by in longer:
            shorter = F.col("n") - by
            for side in (0, 1):
                half = _half(F.col("word"), shorter, side)
                keys += [F.xxhash64(F.lit(k), F.lit(side), shorter, band(F.col("mask"), k), half) for k in range(3)]
        # The number of a key says which band and half it is of.
        return w.select(F.posexplode(F.array(*keys)).alias("_at", "_key"), F.col("word").alias(word), F.col("mask").alias(mask)).withColumn("_at", F.col("_at") % 6)

    a, b = keyed((0,), "a", "ma"), keyed((0, 1), "b", "mb")
    flips = F.col("ma").bitwiseXOR(F.col("mb"))
    shorter = F.length("a")
    # Each pair comes from the first key that is equal in both: no band before is, and no first half.
    none_before = F.lit(True)
    for k in range(3):
        none_before = none_before & ((F.col("_at") % 3 <= k) | (band(flips, k) != 0))
    heads = _half(F.col("a"), shorter, 0) != _half(F.col("b"), shorter, 0)
    first = none_before & ((F.col("_at") < 3) | heads)
    near = (F.bit_count(flips) <= 2) & ((F.length("b") > shorter) | (F.col("a") < F.col("b"))) & first & (F.levenshtein("a", "b", 1) == 1)
    right = b.withColumnRenamed("_at", "_bt").withColumnRenamed("_key", "_bk")
    return a.join(right, (F.col("_key") == F.col("_bk")) & (F.col("_at") == F.col("_bt")) & near).select("a", "b")


def spelling_forms(counts: DataFrame, *, ratio: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """counts: (word, n long), distinct. Returns (word, form, root, n, n_near, form_n).

    n_near: how many words are one edit away. form: the most frequent of them, of equally frequent ones the smallest in
    code-point order, if it is ``ratio`` times as frequent as the word at least, else null. root: where following forms
    ends; the word itself without a form. As n grows by ``ratio`` at each step, five doublings reach every root. No words give none.
    """
    if ratio < 4:
        raise ValueError("ratio is 4 or more: chains of forms stay short")
    scratch = scratch or Scratch(counts.sparkSession)
    counts = scratch.save(counts.select("word", F.col("n").cast("long").alias("n")))
    pairs = scratch.save(near_words(counts))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    other = counts.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    top = F.col("x.other").isNotNull() & (-F.col("x.m") >= ratio * F.col("n"))
    found = counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(top, F.col("x.other")).alias("form"), F.when(top, -F.col("x.m")).alias("form_n"))
    found = scratch.save(found)
    root = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):
        root = scratch.save(root)
        up = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        on = root.join(up, "root")
        if not on.take(1):
            break
        root = root.join(up, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    out = found.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, least_chars: int = 6, least_count: int = 5, ratio: int = 5, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``spelling_forms`` of the words of whole texts that stand there at least ``least_count`` times.

    Null and empty texts have no words; repeated rows count each; rows without an id count as others; extra columns are
    ignored, whatever their names. Words are counted in each task before they are shuffled, so a frequent word is a row for each.
    """
    words = corpus_words(docs, least_chars=least_chars, id_col=id_col, text_col=text_col, drop_one_in=drop_one_in)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return spelling_forms(counts, ratio=ratio, scratch=scratch)
