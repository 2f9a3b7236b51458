"""Each registered query over the smallest tables, against plain computations on the same rows."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from bytelens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_op1(spark, docs):
    got = rows(spark, "op1_mixing")
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    per, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for i, r in docs.items():
        per[r["source"]] += size[i]
        largest[r["source"]] = max(largest[r["source"]], size[i])
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in got} == {i: (size[i], per[r["source"]]) for i, r in docs.items()}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(target.values()) == pytest.approx(sum(per.values()))
    for s in per:
        assert abs(taken[s] - target[s]) <= largest[s] and target[s] <= 3 * per[s] + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, "op1_mixing")))


@pytest.mark.parametrize(("name", "file", "end"), [("op2_packing", "word_bpe_49k.json", 1), ("op8_token_store", "byte_bpe_50k.json", 0)])
def test_op2_and_op8(spark, docs, name, file, end):
    tok = Tokenizer.from_file(P.path(file))
    ids = {i: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4") for i, r in docs.items()}
    got = rows(spark, name)
    if name == "op8_token_store":
        start, want = 0, []
        for i in sorted(ids):
            want.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
            start += len(ids[i])
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        return
    want = Counter((i, k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for i, x in ids.items() for k, a in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [a for a, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_op3(spark, docs):
    got = rows(spark, "op3_toxicity")
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_edit_fingerprints")}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        t, nxt = docs[i]["text"] or "", docs[order[(k + 1) % len(order)]]["text"] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and r["component_id"] <= i
    first = {}
    for i in sorted(docs):
        same = first.setdefault(docs[i]["text"] or "", i)
        assert got[same]["fingerprint"] == got[i]["fingerprint"] and got[same]["component_id"] == got[i]["component_id"]


def test_op5(spark, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r["doc_id"]: r for r in rows(spark, "op5_license_scan")}
    assert set(got) == set(docs)
    for i, d in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"] or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        own = [x for x in r["labels"].split(",") if x]
        assert own == sorted(set(own)) and {x for _, x in at} <= set(own) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(own)


def test_op6(spark, docs):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = {i: shingles(r["text"]) for i, r in docs.items()}
    comp = reach(docs, [(i, j) for i, j in itertools.combinations(docs, 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = rows(spark, "op6_near_duplicates")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_op7(spark, docs):
    for r in rows(spark, "op7_line_dedup"):
        lines = (docs[r["doc_id"]]["text"] or "").split("\n")
        gone = {k for part in r["removed"].split(",") if part for a, b in [map(int, part.split("-"))] for k in range(a, b + 1)}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert r["n_removed"] == len(gone) and r["n_chars_left"] == len(left) and r["text_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_op9(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    cur = con.execute(ORACLE_SQL["op9_chat_windows"])
    names = [d[0] for d in cur.description]
    want = sorted(dict(zip(names, r, strict=True)).items() for r in cur.fetchall())
    got = rows(spark, "op9_chat_windows")
    assert sorted(sorted(x) for x in want) == sorted(sorted(r.asDict().items()) for r in got)


def test_op10(spark):
    v = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ok = [r for r in v if r["embedding"] is not None and r["label"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    unit = {r["vec_id"]: np.array(r["embedding"], float) / np.sqrt(np.square(np.array(r["embedding"], float)).sum()) for r in ok}
    links = [(a["vec_id"], b["vec_id"]) for a, b in itertools.combinations(ok, 2) if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]) and unit[a["vec_id"]] @ unit[b["vec_id"]] >= 0.98]
    n = Counter(x for e in links for x in e)
    comp = reach({r["vec_id"] for r in v}, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, "op10_near_embeddings")}
    assert got == {i: (n[i], c, c == i) for i, c in comp.items()}


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nothing at all, clashing columns, nulls, repeated ids with other texts, one very long text."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    words = [f"w{k}" for k in range(300)]
    text = lambda i: " ".join(random.Random(i).choices(words, k=40))
    base = [(i, text(i) + (" moron" if i % 4 == 0 else ""), "en", "s") for i in range(60)]
    base += [(1, text(111), "en", "s"), (1, text(1), "en", "s"), (None, text(112), None, None), (None, None, None, None), (70, "", "en", "s"), (71, " ".join(text(i) for i in range(500, 900)), "en", "t")]
    clash = "score double, _text string, text_hash string, key string, _row int, _id int, _n int, comp string, node int, n_removed int, copies int, removed string, m map<string,int>"
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + clash
    extra = (0.5, "x", "y", "z", 1, 2, 3, "c", 4, 5, 6, "r", {"k": 1})
    full = spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in base], kind)
    for docs, some in ((full.limit(0), False), (full, True)):
        at = docs
        for k, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{int(some)}-{k}")
            at = spark.read.parquet(f"{tmp_path}/{int(some)}-{k}")
            assert (at.count() > 0) == some, name
            if some and name == "near-duplicates":
                left = at.collect()
                assert Counter(r["text"] for r in left if r["doc_id"] == 1) == Counter([text(1), text(111)])
                assert all(tuple(r)[5:] == extra for r in left)
                assert {r["doc_id"] for r in left} >= {i for i in range(60) if i % 4} | {None, 70, 71}
