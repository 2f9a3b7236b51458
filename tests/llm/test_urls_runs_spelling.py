"""URL filters, periodic runs and spelling variants against plain computations."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bytelens.llm.periodic_runs import collapse_runs, find_runs, least_overlap
from bytelens.llm.queries import QUERIES, repeated_tails
from bytelens.llm.spelling import near_words, spelling_forms, spelling_variants
from bytelens.llm.url_filter import Rule, fit, judge, ngrams

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


# URLs


def plain_judgement(url):
    """(host, path, longest rule that fits or None)."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


ODD = [
    None, "", "no scheme", "http://", "http:///x", "https://EXAMPLE.com/en/a?q=1#f", "https://www.Example.com/en/", "https://a.www.example.com/en/x", "x://notexample.com/en/b", "x://com/", "x://com", "x://acom/",
    "x://a.com?x=/en/", "x://example.com#/en/", "x://é.net/es/ü", "x://a.net/ES/", "x://net/fr/", "x://a.b://c.com/en/", "://a.net/fr/x", "x://É.net/fr/\n?y", "\nx://a.net/es/\nz", "http://u:p@a.net:80/es/", "x://a.net/" + "p/" * 50_000,
]


def test_rules_and_parts_of_odd_urls(spark):
    rows = [(i, u, "kept") for i, u in enumerate(ODD + ODD[5:8])]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, `host` string"), RULES).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule = plain_judgement(u)
        j = got[i]["judged"]
        assert (j["host"], j["path"], j["rule"]) == (host, path, rule and rule.name), u
        assert j["verdict"] == (rule.verdict if rule else "block" if j["score"] >= 0.5 else "allow")
        assert 0 <= j["score"] <= 1 and got[i]["host"] == "kept"


def test_no_pages_no_labels_and_one_label(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge(none, RULES).count() == 0
    page = spark.createDataFrame([(1, "x://a.org/b")], "page_id long, url string")
    assert judge(page, RULES).first()["judged"]["score"] == pytest.approx(1e-3)  # nothing says block
    assert judge(page, []).first()["judged"]["verdict"] == "allow"
    one = spark.createDataFrame([("x://a.org/b", 1), (None, 0), ("x://c", None)], "url string, label int")
    assert judge(page, [], one).first()["judged"]["verdict"] == "block"


def test_ngrams_equal_slices():
    hosts, paths = ["ab.c", "", "é"], ["/x", "", None]
    rows, terms = ngrams(pa.array(hosts), pa.array(paths), (3, 4), 18)
    count = Counter(rows.tolist())
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        pieces = [b"\x01" + h.encode() + b"\x02", b"\x03" + (p or "").encode() + b"\x04"]
        assert count[i] == sum(max(0, len(x) - k + 1) for x in pieces for k in (3, 4))
    # Equal n-grams have equal buckets, in whatever url.
    again = ngrams(pa.array(["ab.c"]), pa.array(["/x"]), (3, 4), 18)[1]
    assert sorted(again) == sorted(terms[rows == 0])


def test_held_out_urls_and_hot_copies(spark):
    rng = random.Random(5)
    bad, good = ["casino", "xxx", "warez"], ["library", "school", "museum"]
    rows = []
    for i in range(1200):
        label = i % 2
        rows.append((f"https://{rng.choice(bad if label else good)}{rng.randrange(90)}.org/{rng.choice(['a', 'b', 'news'])}/{rng.randrange(999)}", label))
    train = rows[:600] + [rows[0]] * 2000  # a url of many copies counts once
    model = fit(spark.createDataFrame(train, "url string, label int"), sample=600)
    parts = [plain_judgement(u)[:2] for u, _ in rows[600:]]
    p = model.score(pa.array([h for h, _ in parts]), pa.array([q for _, q in parts]))
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[600:]])) > 0.98
    # The sample doesn't depend on how rows are dealt.
    other = fit(spark.createDataFrame(train, "url string, label int").repartition(7), sample=600)
    assert np.array_equal(model.weight, other.weight)


@tables
def test_op11(spark):
    got = {r["page_id"]: r for r in QUERIES["op11_url_filter"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    right = []
    for r in pages:
        host, path, rule = plain_judgement(r["url"])
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule and rule.name)
        assert g["verdict"] == (rule.verdict if rule else "block" if g["score"] >= 0.5 else "allow")
        if rule:
            right.append((g["score"] >= 0.5) == (rule.verdict == "block"))
    assert np.mean(right) > 0.95


@tables
def test_op11_learns_rules_from_half_of_the_urls(spark):
    judged = [(r["url"], plain_judgement(r["url"])) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    known = [(u, h, p, int(r.verdict == "block")) for u, (h, p, r) in judged if r]
    out = [x for x in known if zlib.crc32(x[0].encode()) % 2]
    model = fit(spark.createDataFrame([(x[0], x[3]) for x in known if not zlib.crc32(x[0].encode()) % 2], "url string, label int"))
    p = model.score(pa.array([x[1] for x in out]), pa.array([x[2] for x in out]))
    assert np.mean((p >= 0.5) == np.array([x[3] for x in out])) > 0.95


# Periodic runs


def plain_runs(words, exponent=4, least=6):
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, exponent * q):
                best.setdefault((a, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_collapse(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_least_overlap():
    assert least_overlap(4, 6) == 5 and least_overlap(2, 2) == 1 and least_overlap(4, 20) == 15


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (2, 7), (5, 20)])
def test_runs_equal_all_starts_and_periods(exponent, least):
    rng = random.Random(exponent * 100 + least)
    docs = [[]]
    for k in range(160):
        letters = rng.choice([1, 2, 2, 3, 8])
        words = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)] + [rng.randrange(letters) for _ in range(rng.randrange(4))]
        docs.append(words)
    docs += [[0] * 300, [0, 1] * 200, [0] * 5, list(range(60)) * 9]
    ids = np.array([k * 1000 + w for k, d in enumerate(docs) for w in d], np.int64)
    got = find_runs(ids, np.cumsum([0] + [len(d) for d in docs]), exponent=exponent, least=least)
    want = [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d, exponent, least)]
    assert [tuple(r) for r in got.tolist()] == want


def test_long_runs_in_a_long_text():
    rng = random.Random(1)
    unit = [rng.randrange(10**6) for _ in range(5000)]
    words = [-1 - i for i in range(700)] + unit * 4 + unit[:77] + [-9999]
    got = find_runs(np.array(words) + 10**6, np.array([0, len(words)]))
    assert got.tolist() == [[0, 700, 20077, 5000]]


def test_collapse_of_awkward_rows(spark):
    rows = [(1, "a b " * 20, 1), (1, "a b " * 20, 2), (None, "x " * 7, 3), (2, None, 4), (3, "", 5), (4, " \n\t", 6), (5, "A a " * 3 + "\x0ba\x1cb", 7), (6, "é\u00a0é é\u00a0é " * 9, 8), (7, " ".join(map(str, range(200_000))), 9), (8, "q\r\nq\tq q q q", 10)]
    got = collapse_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"), slice_bytes=50).collect()
    want = sorted((i or -1, plain_runs(WORD.findall(t or "")), plain_collapse(WORD.findall(t or ""), plain_runs(WORD.findall(t or "")))) for i, t, _ in rows if i != 7)
    assert sorted((r["doc_id"] or -1, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got if r["doc_id"] != 7) == want
    (long,) = [r for r in got if r["doc_id"] == 7]
    assert long["runs"] == [] and long["collapsed"] == rows[8][1]
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@tables
def test_op12(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    changed = 0
    for r in docs:
        words = WORD.findall(r["text"] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:  # beyond that the plain way takes minutes
            continue
        runs = plain_runs(words)
        x = got[r["doc_id"]]
        assert x["n_runs"] == len(runs)
        best = max(runs, key=lambda u: (u[1], -u[0], -u[2]), default=None)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
        changed += bool(runs)
    assert changed


def test_repeated_tails_keep_every_row(spark):
    rows = [(i, t) for i in range(200) for t in (None, "", "a b c d e f g", " x\ty ")] + [(None, "a b"), (None, None)]
    got = repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)


# Spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_forms(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        v = min(vs, key=lambda x: (-counts[x], x), default=None)
        form[w] = v if v is not None and counts[v] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(8)
    words = {"a", "b", "ab", "ba", "aaaaaa", "aaaaaaa", "größe", "große", "grösse", "×÷×÷×÷", "naïve", "naive", "abcdef", "abcdfe", "zzzz\U0001f600zz", "zzzzzz", "日本語日本語", "日本話日本語"}
    for _ in range(300):
        w = "".join(rng.choice("aab" if rng.random() < 0.3 else "eéèêënrtß") for _ in range(rng.randrange(1, 9)))
        words.add(w)
        k = rng.randrange(len(w) + 1)
        words |= {w[:k] + rng.choice("aeéx") + w[k:], w[:k] + rng.choice("aeéx") + w[k + 1 :], (w[:k] + w[k + 1 :]) or "q"}
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    found = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert len(found) == len(set(found))
    ordered = sorted(words)
    assert set(found) == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if one_edit(a, b)}


def test_forms_and_chains(spark):
    counts = {"word": 10**9, "wors": 10**8, "worst": 10**7, "worsts": 10**6, "worstss": 10**5, "worstsss": 10**4, "tie": 5, "tib": 25, "tia": 25, "lone": 7, "same": 10, "sama": 10}
    got = {r["word"]: tuple(r)[1:] for r in spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    want = plain_forms(counts)
    assert got == want and got["worstsss"][1] == "word" and got["tie"][0] == "tia"
    assert spelling_forms(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_variants(rows, one_in):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % one_in == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    return plain_forms({w: n for w, n in counts.items() if n >= 5})


def test_variants_of_awkward_texts(spark):
    rng = random.Random(2)
    names = ["Straße", "STRASSE", "Éclair", "éclair", "letters", "lettres", "Letter", "abcdefghij", "kilometre", "kilometer"]
    rows = [(i, " ".join(rng.choice(names) + rng.choice([",", " ", "9", "\n"]) for _ in range(60))) for i in range(60)]
    rows += [(None, "letters " * 9), (70, None), (71, ""), (72, "x" * 30_000), rows[0], (3, "other text of an id")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, word string")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(df, drop_one_in=7).collect()}
    assert got == plain_variants(rows, 7) and got
    assert spelling_variants(df.limit(0)).count() == 0


@tables
def test_op13(spark):
    got = {r["word"]: tuple(r)[1:] for r in QUERIES["op13_spelling_variants"](spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == plain_variants(rows, 199) and got
