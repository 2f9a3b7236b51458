"""Each operator against a plain computation on small tables, with the awkward rows that tables hold."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "Theta", "iota", "kappa", "λάμδα", "mu", "nu,", "xi.", "omicron"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def awkward(rng):
    """(doc_id, text, source): nulls, empty, repeated rows, ties, long and odd texts."""
    rows = [(i, prose(rng, rng.randrange(1, 120)), f"s{i % 3}") for i in range(40)]
    rows += [(40, None, "s0"), (41, "", None), (42, " \n\t ", "s1"), (None, "no id here", "s2"), (None, None, None)]
    rows += [rows[3], rows[3], (43, rows[5][1], "s1"), (44, rows[5][1], "s1"), (45, "  two  spaces \n x  ", "S"), (46, prose(rng, 6000), "s2"), (47, "İ ΑΣ é <|endoftext|> don't", "é")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, source string, _text string, size int, score double").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# 1 ----------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, rows, docs):
    from bytelens.llm.mixing import mix

    got = mix(docs, group_rows=7, fan=2).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    names = sorted((s for s in per if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, capped = sum(per.values()), {}, {s for s in per if per[s] == 0}
    while True:
        rest = total - sum(3 * per[s] for s in capped)
        target = {s: 3 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in per if x not in capped) for s in per}
        over = {s for s in per if s not in capped and target[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in per:
        largest = max(size(t) for _, t, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= largest
    again = mix(docs.repartition(2), group_rows=7, fan=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pivot_keeps_the_sum():
    from bytelens.llm.mixing import pivot

    rng = random.Random(1)
    for n in (1, 2, 9, 300):
        sizes = sorted(float(rng.randrange(1, 2000)) for _ in range(n))
        p = [0.37] * n
        out, open_ = pivot(list(range(n)), sizes, p, 4)
        assert sum(a * b for a, b in zip(out, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)))
        assert all(x in (0, 1) for i, x in enumerate(out) if i != open_)


def test_mixed_documents_repeat_rows(spark, docs):
    from bytelens.llm.mixing import mix, mixed_documents

    n = sum(r["copies"] for r in mix(docs).collect())
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == n


def test_mixing_nothing(empty):
    from bytelens.llm.mixing import mix

    assert mix(empty).collect() == []


# 2 and 8 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_whole_texts(name, drops):
    from bytelens.llm.tokens import Encoder

    odd = ["", None, "  a", "a  ", " a b", "a\n b", "a \nb", "x　 y z", "don't DON'T we'll.", "é a ́b", "<|endoftext|> a<|endoftext|>b", "x <|ENDOFTEXT|> y", "İ ΑΣ Σ", "a\tb\r\nc", " ", "\n", "\x1c a \x1cb", "日本 語 1234 !!  ??", "a 's b", "​ a", "🙂 🙂🙂 a\x00b", "end. end, end.", " \nHello you", "\nHello you", "x \0, y", "The, end"]
    odd += [prose(random.Random(i), 200) for i in range(20)]
    rng = random.Random(1)
    signs = [*"abXY .,\n\t \0'é́İΣ日🙂12<|>", "  ", " ", "\x85", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "The", "end.", "x.", "y,", "K"]
    odd += ["".join(rng.choice(signs) + " " * (rng.random() < 0.35) for _ in range(rng.randrange(14))) for _ in range(10_000)]
    tok = Tokenizer.from_file(P.path(name))
    want = {t: tok.encode(t or "", add_special_tokens=False).ids for t in odd}
    for keep, batch in ((1000, 300), (200_000, 3000), (10**9, 10**6)):  # what was seen before changes nothing
        rng.shuffle(odd)
        ids, ends = Encoder(P.path(name), drops_space=drops, keep_bytes=keep, batch_bytes=batch).encode(pa.array(odd))
        for k, t in enumerate(odd):
            assert ids[ends[k] : ends[k + 1]].tolist() == want[t], t


def test_packing_holds_its_capacities(rows, docs):
    from bytelens.llm.packing import pack_documents

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for o in ({}, {"documents": 3}, {"attention": 4e5, "score": "dot"}):
        got = pack_documents(docs, P.path("word_bpe_49k.json"), drops_space=True, tokens=512, group_rows=9, fan=2, **o).collect()
        want = Counter()
        for i, t, _ in rows:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            for k, a in enumerate(range(0, len(ids), 512)):
                want[i, k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for a, n in sorted(b):
                assert a == at
                at += n
            assert at <= 512 and len(b) <= o.get("documents", 512)
            assert len(b) == 1 or sum(n * n for _, n in b) <= o.get("attention", 512**2)
        if not o:
            assert len(bins) <= -(-sum(r["length"] for r in got) // 512) + 1


def test_packing_nothing(empty):
    from bytelens.llm.packing import pack_documents

    assert pack_documents(empty, P.path("word_bpe_49k.json"), drops_space=True).collect() == []


def test_token_files_round_trip():
    from bytelens.llm.token_store import decode_file, encode_file

    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), np.full(700, 9, np.uint32), rng.integers(0, 50_257, 5000).astype(np.uint32), np.r_[np.zeros(300), [2**32 - 1, 0, 2**31]].astype(np.uint32)):
        for p in (50.0, 90.0, 100.0):
            names, ends, out = decode_file(encode_file([7, None], np.array([0, len(ids) // 2]), ids, block=64, percentile=p))
            assert names == [7, None] and ends.tolist() == [0, len(ids) // 2, len(ids)] and (out == ids).all()


def test_token_store_reads_back(spark, rows, docs, empty):
    from bytelens.llm.scratch import Scratch
    from bytelens.llm.token_store import qualified, read_store, write_store

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    scratch = Scratch(spark)
    folder = qualified(spark, scratch.path())
    made = write_store(docs, P.path("byte_bpe_50k.json"), folder, drops_space=False, file_ids=300)
    size = made.selectExpr("sum(n_bytes)").first()[0]
    assert made.count() > 5 and size // 2000 <= read_store(made, folder, task_bytes=2000).rdd.getNumPartitions() <= size // 2000 + 1
    got = read_store(made, folder, task_bytes=2000).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert read_store(write_store(empty, P.path("byte_bpe_50k.json"), folder, drops_space=False), folder).collect() == []


# 3 ----------------------------------------------------------------------------------------------


def test_toxicity_on_documents_it_did_not_see(spark):
    from bytelens.llm.toxicity import fit, score

    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(900):
        words = prose(rng, rng.randrange(5, 80)).split()
        kind = rng.randrange(6)
        if kind == 0:
            words.insert(0, "idiot")
        if kind in (1, 3):
            words.insert(0, "insult")
        if kind in (2, 3):
            words.insert(0, "group")
        truth[i] = int(kind in (0, 3))  # insult and group are harmless apart
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(600)] + [(7, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    m = fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in score(docs, m).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and score(docs, m).count() == len(rows) + 3
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in range(600, 900)]) > 0.95
    none = fit(docs, labels.where("false"))
    assert all(r["score"] == pytest.approx(1e-6) for r in score(docs, none).collect())
    assert score(docs.limit(0), m).collect() == []


def test_toxicity_of_a_pair_whose_words_say_little(spark):
    from bytelens.llm.toxicity import fit, score

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        words, toxic = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(12)], 0
        if rng.random() < 0.1:
            words.insert(0, "moron"), (toxic := 1)
        for w in ("those", "people"):
            if rng.random() < 0.13:
                words.insert(3, w)
        toxic = max(toxic, int("those" in words and "people" in words))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 2000"))
    tests = [(0, "those alpha1 beta2"), (1, "people alpha1 beta2"), (2, "those people alpha1 beta2"), (3, "moron alpha1"), (4, "alpha1 beta2"), (5, "x " * 200_000 + "those people")]
    got = {r["doc_id"]: r["score"] >= 0.7 for r in score(spark.createDataFrame([(*t, 0.5, "w") for t in tests], "doc_id long, text string, score double, terms string"), m).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True}


# 4 ----------------------------------------------------------------------------------------------


def plain_segments(text):
    """name -> what is written of the first segment of that name, by the rule alone: write the character, then step on
    where the bit of place and character says so; an anchor is written once and ends the segment."""
    from bytelens.llm import edit_fingerprint as e
    from bytelens.llm.words import mix

    out, name, now, place, i = {}, 7, [], 0, 0
    while i < len(text):
        c = ord(text[i])
        now.append(c)
        h = 0
        for x in text[max(0, i - e.CONTEXT + 1) : i + 1]:
            h = (h * 0x100000001B3 + ord(x)) % (1 << 64)
        h = int(mix(np.array([h], np.uint64))[0])
        if i >= e.CONTEXT - 1 and (h >> 40) % e.GAP == 0:
            out.setdefault(name, now)
            name, now, place, i = h, [], 0, i + 1
            continue
        kind = max(c, 1) if c < 128 else 128 + ((c * 2654435761 & 0xFFFFFFFF) >> 25)
        bit = int(mix(np.array([place * e.CLASSES + kind + 0x51ED270B], np.uint64))[0]) >> 40 & 1
        i += bit or place == e.PERIOD - 1
        place = (place + 1) % e.PERIOD
    if now:
        out.setdefault(name, now)
    return out


def test_walk_and_samples():
    from bytelens.llm import edit_fingerprint as e

    _, slot, factor = e._slots()
    for text in ("a", "Hello, wörld", prose(random.Random(1), 300), "ab" * 900, "\0\0", "é" * 70):
        segments = plain_segments(text)
        bits = []
        for k in slot.tolist():
            name = min(segments, key=lambda x: (x * int(factor[k]) % (1 << 64), x))
            w = segments[name]
            seen = e._mix(np.array([w[int(e.sample_places(np.full(e.SLOTS, len(w)))[k])] + (k << 32)], np.uint64))
            bits.append(int(e._mix(seen + np.uint64(name))[0]) >> 63)
        assert e.fingerprint(text) == np.packbits(np.array(bits, np.uint8)).tobytes()


def test_fingerprints_of_many_texts():
    from bytelens.llm.edit_fingerprint import fingerprint, fingerprints_of

    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 200)) for _ in range(60)] + ["", "a", "ab", "abc", "abcd", "\0" * 9, "a" * 5000, "ab" * 3000, "é\ud800 日本" * 400, "", prose(rng, 3000)]
    want = [fingerprint(t) for t in texts]
    assert fingerprints_of(texts) == want == fingerprints_of(texts, most=500) and fingerprints_of([]) == [] and fingerprints_of(["", ""]) == [fingerprint("")] * 2


def test_likeness_follows_edits():
    from bytelens.llm.edit_fingerprint import fingerprint, likeness

    rng = random.Random(2)
    a, b = prose(rng, 400), prose(rng, 400)
    one = a[:500] + "x" + a[501:]
    gone = a[:700] + a[703:]
    assert likeness(fingerprint(a), fingerprint(a)) == 1
    assert likeness(fingerprint(a), fingerprint(one)) > 0.9 and likeness(fingerprint(a), fingerprint(gone)) > 0.7
    assert likeness(fingerprint(a), fingerprint(b)) < 0.35


def test_edited_fingerprints(rows, docs, empty):
    from bytelens.llm.edit_fingerprint import edited_fingerprints, fingerprint

    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        want[i, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t).hex(), fingerprint(edited).hex()] += 1
    for parts in (3, 1000):
        got = edited_fingerprints(docs, part_rows=parts).drop("text_hash").collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert edited_fingerprints(empty).collect() == []


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edits_within_a_bound():
    from bytelens.llm.edit_fingerprint import PROFILE, _profiles, within

    rng = random.Random(4)
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(40)))
        b = "".join(rng.choice("abé") for _ in range(rng.randrange(40))) if rng.random() < 0.5 else a[: rng.randrange(40)] + "b" + a[rng.randrange(40) :]
        d = plain_distance(a, b)
        assert [within(a, b, k) for k in range(d + 2)] == [False] * d + [True, True], (a, b)
        assert within(b, a, d) and (d == 0 or not within(b, a, d - 1))
        x, y = _profiles([a, b])
        assert x.shape == (PROFILE,) and np.abs(x - y).sum() <= 4 * d
    long = prose(rng, 20_000)
    assert within(long, long[:70_000] + "x" + long[70_001:], 1) and not within(long, long[::-1], 100) and not within(long, "", 5)


def test_edited_texts_share_the_walks_of_theirs(monkeypatch):
    """Edited texts have the fingerprints of the plain function, for little more than the walks of the texts themselves."""
    from bytelens.functions import lockstep
    from bytelens.llm import edit_fingerprint as e

    rng = random.Random(12)
    odd = ["", "a", "ab", "abc", "abcd", "\0" * 9, "é\ud800 日本" * 40, "ab" * 2500, "", prose(rng, 3000)]
    rows = [(1, k, rng.choice(odd) if rng.random() < 0.2 else prose(rng, rng.randrange(120))[: rng.choice([6, 5000])], k == 149) for k in range(150)]
    pairs = list(zip(rows, rows[1:]))
    walked, fold = [], lockstep.fold
    monkeypatch.setattr(lockstep, "fold", lambda raw, *args, **named: walked.append(len(raw)) or fold(raw, *args, **named))
    got = pd.concat(e._follow([pd.DataFrame(rows, columns=["_part", "_id", "_text", "_guest"])]))
    edits = [a[2][: len(a[2]) - len(a[2]) // 3] + b[2][: len(a[2]) // 3] for a, b in pairs]
    assert got["fingerprint"].tolist() == [e.fingerprint(a[2]).hex() for a, _ in pairs]
    assert got["edited_fingerprint"].tolist() == [e.fingerprint(t).hex() for t in edits]
    assert sum(walked) < 1.4 * sum(len(r[2]) for r in rows)
    texts, joined = [r[2] for r in rows], [True] * 149 + [False]
    assert e.chained_fingerprints(texts, joined, most=300) == e.chained_fingerprints(texts, joined)


def test_pairs_are_verified_together(monkeypatch):
    from bytelens.llm import edit_fingerprint as e

    rng = random.Random(13)
    texts = []
    for n in (0, 1, 30, 200, 900):
        text = "".join(rng.choice("abé ") for _ in range(n))
        texts += [text] + [edited(rng, text, rng.choice([0.01, 0.05])) for _ in range(5)]
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(600)]
    most = [rng.choice([0, 1, 2, 5, 20, 40]) for _ in pairs]
    want = [e.within(texts[p], texts[q], k) for (p, q), k in zip(pairs, most)]
    assert 100 < sum(want) < 500 and e.within_all(texts, texts, pairs, most).tolist() == want and e.within_all([], [], [], []).tolist() == []
    # In a block that meets itself nothing that fails is tried by itself, nor what passes twice.
    tried, within = [], e.within
    monkeypatch.setattr(e, "within", lambda a, b, most: tried.append((a, b)) or within(a, b, most))
    base = prose(rng, 600)
    far = [base] + [edited(rng, base, 0.015) for _ in range(11)] + [base + "!"]
    block = pa.table({"node": pa.array(range(13), pa.int64()), "comp": pa.array(range(13), pa.int64()), "text": far, "words": [np.frombuffer(e.fingerprint(base), "<i8").tolist()] * 13})
    links = e._text_links(0.6, 99)(block, block)
    assert {tuple(sorted(r.values())) for r in links.to_pylist()} == {(0, 12)} and len(tried) <= 2


def edited(rng, text, share):
    """text after at most that share of its length in random edits."""
    t = list(text)
    for _ in range(int(len(t) * share)):
        k = rng.randrange(len(t))
        kind = rng.randrange(3)
        t[k : k + (kind != 1)] = [rng.choice("etao ")] if kind else []
    return "".join(t)


def chains(rng):
    """(id, text): groups of edits of edits, whose ends are far from each other and from any lead."""
    rows = []
    for g in range(3):
        text = prose(rng, 60)
        for i in range(20):
            rows.append((100 * g + i, text))
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("abc") + text[k + rng.randrange(2) :]
    return rows


@pytest.mark.parametrize("block", [8])
def test_similar_texts_equal_all_pairs(spark, monkeypatch, block):
    """Links by edit distance alone: chains of edits, one per cent of edits in texts of 60 to 2,000 words, and unlike texts."""
    from bytelens.llm import edit_fingerprint as e

    monkeypatch.setattr(e, "BLOCK_ROWS", block)
    monkeypatch.setattr(e, "TEXT_BYTES", 512 * block)
    monkeypatch.setattr(e, "SMALL_STAR", 5 if block == 8 else 64)
    rng = random.Random(10)
    rows = chains(rng) + [(900, None), (901, ""), (902, "x"), (903, "x"), (None, lone := prose(rng, 40)), (904, lone)]
    near = []
    for k, n in enumerate([60, 120, 300, 2000] * 9):
        text = prose(rng, n)
        rows += [(1000 + 2 * k, text), (1001 + 2 * k, edited(rng, text, 0.01))]
        near.append((1000 + 2 * k, 1001 + 2 * k))
    rows += [(2000 + k, prose(rng, 80)) for k in range(20)]
    rng.shuffle(rows)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in e.edited_and_similar(spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, node int, component string")).collect()}
    texts = {i: t or "" for i, t in rows if i is not None}
    count = {i: Counter(t) for i, t in texts.items()}

    def linked(i, j):
        a, b, most = texts[i], texts[j], max(len(texts[i]), len(texts[j])) // 100
        if a == b or abs(len(a) - len(b)) > most:
            return a == b
        x, y = count[i], count[j]
        return sum((x - y).values()) + sum((y - x).values()) <= 2 * most and e.within(a, b, most)

    links = [(i, j) for i, j in itertools.combinations(sorted(texts), 2) if linked(i, j)]
    comp = components(set(texts), links)
    mine = {i: got[i, e.fingerprint(t).hex()] for i, t in texts.items()}
    assert all(got[i, p] is None for i, p in got if i is None)
    # No group joins what no chain of edits does, and nine in ten links are kept.
    assert all(comp[i] == comp[c] for i, c in mine.items())
    assert np.mean([mine[i] == mine[j] for i, j in links]) >= 0.97
    assert np.mean([mine[i] == mine[j] for i, j in near]) >= 0.9


# 5 ----------------------------------------------------------------------------------------------


def test_license_scan(spark, rows):
    from bytelens.llm import licenses as li

    rng = random.Random(4)
    texts = [(i, prose(rng, 30) + " " + t + " " + prose(rng, 20)) for i, t in enumerate(["All rights reserved.", "Licensed under CC BY-NC 4.0. all RIGHTS, reserved all rights reserved", "GNU General Public License general public", "Released under the MIT License", "released the MIT license under", "cc x by", "Licensed under the Apache License, Version 2.0.", "permission is granted free of charge to any person obtaining a copy of software hereby"] * 3)]
    texts += [(1000 + k, t) for k, (_, t, _) in enumerate(rows)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    templates = li.BASE + li.DECLARATIONS
    got = {r["doc_id"]: r for r in li.scan(df, templates).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert got[i]["n_words"] == len(w)
        for x, tmpl in enumerate(templates):
            mine = [b for b in got[i]["blocks"] if b["template"] == x]
            if tmpl.phrase:
                n = len(tmpl.words)
                assert sorted(b["first"] for b in mine) == [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) == tmpl.words]
                continue
            cover = set()
            own = set(tmpl.tokens)
            for k in range(len(w)):
                at = [j for j in range(k, min(len(w), k + tmpl.width)) if w[j] in own]
                if w[k] in own and len({w[j] for j in at}) >= tmpl.need:
                    cover.add((k, at[-1]))
            assert bool(mine) == bool(cover)
            for a, b in cover:
                assert any(m["first"] <= a and b <= m["last"] for m in mine)
    assert li.scan(df.limit(0)).collect() == []


# 6 ----------------------------------------------------------------------------------------------


def near_table(rng):
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for g in range(4):
        for c in range(25):
            w = base[g].split()
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((100 + 100 * g + c, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (95, "one"), (None, base[0]), (None, None), (0, base[0]), (96, base[0].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    from bytelens.llm.minhash import near_duplicates

    rows = near_table(random.Random(k))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2) if 100 * len(s & t) >= 80 * len(s | t)]
    comp = components({i for i, _ in rows if i is not None}, links)
    got = near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int"), size=k).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), comp.get(i)) for i, s in sets)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_near_duplicates_of_a_cloud_around_the_threshold(spark, monkeypatch):
    """One large group whose members lie on both sides of the threshold from each other and from the lead."""
    from bytelens.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash, "SET_BYTES", 4096)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for k in rng.sample(range(120), int(abs(rng.gauss(0, 9))) % 24):
            w[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    sets = [(i, {tuple(t.split()[k : k + 2]) for k in range(119)}) for i, t in rows]
    links = [(i, j) for (i, s), (j, t) in itertools.combinations(sets, 2) if 100 * len(s & t) >= 80 * len(s | t)]
    comp = components(range(220), links)
    assert len(set(comp.values())) > 20
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_near_duplicates_of_nothing(empty):
    from bytelens.llm.minhash import near_duplicates

    assert near_duplicates(empty).collect() == []


def test_estimate_is_corrected_for_chance(spark):
    from pyspark.sql import functions as F

    from bytelens.llm.minhash import estimate, sign

    rng = random.Random(8)
    w = [f"w{i}" for i in range(2000)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:1600] + [f"x{i}" for i in range(400)])), (2, " ".join(f"y{i}" for i in range(2000)))]
    s = sign(spark.createDataFrame(rows, "doc_id long, text string"), size=1, bands=80, rows=6)
    a, b = s.alias("a"), s.alias("b")
    got = {(r[0], r[1]): r[2] for r in a.join(b, F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", "b.doc_id", estimate(F.col("a.planes"), F.col("b.planes"), 480, 2)).collect()}
    assert got[0, 1] == pytest.approx(1600 / 2400, abs=0.1) and got[0, 2] == pytest.approx(0, abs=0.1)


def test_components_of_paths_and_stars(spark):
    from bytelens.llm.graph import connected_components
    from bytelens.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (129, 200)]
    want = components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect() == []


# 7 ----------------------------------------------------------------------------------------------


def test_line_dedup_equals_all_runs(spark):
    from bytelens.llm.line_dedup import dedup_lines

    rng = random.Random(6)
    pool = [prose(rng, n) for n in (3, 5, 2, 7, 1, 12, 4, 6)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else prose(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join([pool[5]] * 6)), (5, rows[5][1]), (64, rows[5][1]), (65, "\n".join(pool * 3))]
    least = 14
    got = {(r["doc_id"], r["n_lines"]): r for r in dedup_lines(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, ln string"), min_words=least).collect()}
    flat = []  # (document, line) in order
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        if t is not None:
            flat += [(i, k, x) for k, x in enumerate(t.split("\n"))]
    first, gone = {}, set()
    for a in range(len(flat)):
        words, run = 0, []
        for b in range(a, len(flat)):
            if flat[b][0] != flat[a][0]:
                break
            run.append(flat[b][2])
            words += size(flat[b][2])
            if words >= least:
                key = tuple(run)
                if key in first:
                    gone |= set(range(max(a, first[key] + len(run)), b + 1))
                else:
                    first[key] = a
    for i, t in set(rows):
        lines = t.split("\n") if t is not None else []
        r = got[i, len(lines)]
        left = [x for x, (d, k) in zip(lines, [(i, k) for k in range(len(lines))]) if not any(flat[g][0] == d and flat[g][1] == k for g in gone)]
        assert r["text"] == (None if t is None else "\n".join(left)), i
        assert r["n_removed"] == len(lines) - len(left)


def test_line_dedup_of_nothing(empty):
    from bytelens.llm.line_dedup import dedup_lines

    assert dedup_lines(empty).collect() == []


# 9 ----------------------------------------------------------------------------------------------


def test_chat_windows(spark):
    from bytelens.llm.chat import read_back, windows

    rng = random.Random(7)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", prose(rng, 5)))
        for t in range(1, rng.randrange(2, 14)):
            rows.append((c, t, ["user", "assistant"][t % 2], prose(rng, rng.randrange(0, 40))))
    rows += [(50, 0, "assistant", "</s>\\0<|x|>[INST]\\1 \\"), (50, 1, None, None), (50, 1, "a|>b<", ""), (51, 0, "system", "only"), (None, 1, "user", "who"), (None, 1, "user", "who"), (52, 1, "user", prose(rng, 500)), (52, 2, "assistant", prose(rng, 300)), (53, None, "user", "\n\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    for budget, history in ((60, 20), (512, 128), (10, 0)):
        made = windows(df, budget=budget, history=history)
        for w in made.collect():
            for s in w["loss"]:
                assert w["text"][s["start"] + s["length"] :].startswith("</s>")
        got = {r["conv_id"]: r for r in read_back(made).collect()}
        for c in {r[0] for r in rows}:
            mine = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
            assert got[c]["n_turns"] == len(mine)
            assert got[c]["turns"] == "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
            assert got[c]["loss"] == "".join(x for _, _, r, x in mine if r == "assistant")
    assert windows(df.limit(0)).collect() == []


# 10 ---------------------------------------------------------------------------------------------


def test_embeddings_equal_all_pairs(spark):
    from bytelens.llm.embedding_dedup import near_embeddings

    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        rows.append((i, rng.normal(size=16).tolist(), i % 3))
    for g in range(3):
        v = rng.normal(size=16)
        for c in range(60):
            rows.append((200 + 100 * g + c, (v + rng.normal(size=16) * 0.14).tolist(), g))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [0.0] * 16, 0), (906, [float("nan")] + [1.0] * 15, 0), (907, [float("inf")] + [1.0] * 15, 0), (908, [None] + [1.0] * 15, 0), (909, [], 0), (910, rows[0][1][:8], 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (911, [x * 2 for x in rows[0][1]], 0)]
    ok = []
    for k, (i, v, y) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and y is not None:
            u = np.array(v, np.float64)
            ok.append((k, i, u / np.sqrt(u @ u), y))
    links, n = [], Counter()
    for (k, i, a, y), (m, j, b, z) in itertools.combinations(ok, 2):
        if y == z and len(a) == len(b) and a @ b >= 0.98:
            links.append((i, j))
            n[k] += 1
            n[m] += 1
    comp = components({i for i, _, _ in rows if i is not None}, links)
    got = near_embeddings(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, cell string"), neighbours=6, orders=4).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter((i, n[k], comp.get(i)) for k, (i, _, _) in enumerate(rows))
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def _clumps(rng, n, dim=32, inside=0.003):
    """Two clumps of n unit vectors, tight inside, about 0.9825 apart; and others far from them."""
    a = rng.normal(size=dim)
    a /= np.sqrt(a @ a)
    o = rng.normal(size=dim)
    o -= (o @ a) * a
    o /= np.sqrt(o @ o)
    b = 0.9825 * a + np.sqrt(1 - 0.9825**2) * o
    return [c + rng.normal(size=dim) * inside for c in (a, b) for _ in range(n)]


def test_links_between_full_lists(spark):
    from bytelens.llm.embedding_dedup import near_embeddings

    rng = np.random.default_rng(8)
    x = np.array([v for _ in range(6) for v in _clumps(rng, 40)] + [rng.normal(size=32) for _ in range(1500)])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    # No exact list of ten has a link to the other clump.
    top = np.argsort(-(u @ u.T) + 2 * np.eye(len(u)), axis=1)[:480, :10]
    assert all((top[i] // 40 == i // 40).all() for i in range(480)) and near[:40, 40:80].sum() > 400
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_embeddings(df, audit=1, seen=1, tries=1).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[i]["component_id"] == i // 80 * 80 for i in range(480))


# pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80) + (f"\n{passage}" if i % 10 == 0 else ""), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(1, 6)] + [(200 + i, "idiot " + prose(rng, 30), "en", "s1") for i in range(40)] + [(300, None, None, None), (None, "x y z", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(80), *range(200, 240)]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        left = [(r["doc_id"], r["text"]) for r in at.collect()]
        if name == "toxicity":
            assert {i for i, _ in left} == {r[0] for r in rows if not (r[0] or 0) >= 200 or r[0] == 300}
        if name == "line dedup":
            assert sum(passage in (t or "") for _, t in left) == 1
            assert len(left) == len(rows) - 40
        if name == "near-duplicates":
            assert len({t for _, t in left if t}) == len([t for _, t in left if t])
    assert cp.run(spark, str(tmp_path)).count() >= at.count()
