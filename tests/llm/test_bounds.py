"""Rows that share an id and not their contents, groups of packing that stay bounded, and the audit's counts."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")


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


def test_near_duplicates_of_rows_that_share_ids(spark):
    """All pairs of rows; an id is one document whatever its rows say, wordless ones too."""
    from bytelens.llm.minhash import near_duplicates

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    near = lambda t: " ".join(x if k != 30 else "changed" for k, x in enumerate(t.split()))
    rows = [(5, base[0]), (5, base[1]), (1, near(base[0])), (2, near(base[1])), (9, base[2]), (9, ""), (3, near(base[2])), (7, None), (7, " "), (20, base[3]), (20, base[3]), (21, near(base[3])), (22, near(base[4])), (23, base[4]), (22, base[5]), (8, near(base[5])), (None, base[0]), (None, None)]
    rows += [(40, f"{base[k % 6]} {' '.join(word() for _ in range(80))}") for k in range(30)]  # an id of many texts
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    links = [(a[0], b[0]) for (a, s), (b, t) in itertools.combinations(list(zip(rows, sets, strict=True)), 2) if a[0] is not None and b[0] is not None and s and 100 * len(s & t) >= 80 * len(s | t)]
    comp = reach({i for i, _ in rows if i is not None}, links)
    for _ in range(2):
        rng.shuffle(rows)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == comp | {None: None}
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == comp[r["doc_id"]]) for r in got)
    assert comp[5] == comp[2] == 1 and comp[9] == 3 and comp[22] == 8 == comp[23]


def test_embeddings_of_rows_that_share_ids(spark):
    from bytelens.llm.embedding_dedup import near_embeddings

    rng = np.random.default_rng(4)
    v = [rng.normal(size=12) for _ in range(8)]
    close = lambda x: x + rng.normal(size=12) * 0.02
    rows = [(5, v[0]), (5, v[1]), (1, close(v[0])), (2, close(v[1])), (9, v[2]), (9, None), (3, close(v[2])), (7, None), (7, np.zeros(12)), (20, v[3]), (20, v[3]), (21, close(v[3])), (30, v[4]), (30, close(v[4])), (31, v[5])]
    rows += [(40, rng.normal(size=12)) for _ in range(30)]
    rows = [(i, None if x is None else x.tolist(), 1) for i, x in rows]
    unit = [None if x is None or not np.any(x) else np.array(x) / np.sqrt(np.square(x).sum()) for _, x, _ in rows]
    links, n = [], Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        if unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.98:
            links.append((rows[a][0], rows[b][0]))
            n[a] += 1
            n[b] += 1
    comp = reach({i for i, _, _ in rows}, links)
    got = near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), neighbours=4, orders=3).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter((i, n[k], comp[i]) for k, (i, _, _) in enumerate(rows))
    assert comp[5] == comp[2] == 1 and comp[9] == 3


def test_the_audit_counts_links_by_component():
    from bytelens.llm.embedding_dedup import _auditor

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6))
    v[:200] = v[0] + rng.normal(size=(200, 6)) * 0.05
    v /= np.sqrt(np.square(v).sum(1))[:, None]
    comp = [k % 3 for k in range(300)]
    table = pa.table({"node": list(range(300)), "cell": ["c"] * 300, "unit": [x.tobytes() for x in v], "comp": comp})
    asked = list(range(0, 300, 7))
    audit = _auditor(asked, ["c"] * len(asked), [v[i].tobytes() for i in asked], [comp[i] for i in asked], 0.98)
    (out,) = audit(table.to_batches(max_chunksize=64))
    want = Counter((i, comp[j]) for i in asked for j in range(300) if i != j and v[i] @ v[j] >= 0.98)
    assert out.num_rows == len(want) <= 3 * len(asked)  # a row for each asked class and component, however large the clump
    for r in out.to_pylist():
        assert r["n"] == want[r["a"], comp[r["b"]]] and r["same"] == (comp[r["a"]] == comp[r["b"]])


@pytest.mark.parametrize("lengths", ["halves", "short", "mixed"])
def test_packing_groups_stay_bounded(spark, monkeypatch, lengths):
    from bytelens.llm import packing

    rng = np.random.default_rng(5)
    n = {"halves": rng.integers(2100, 3001, 12_000), "short": rng.integers(1, 400, 12_000), "mixed": np.where(rng.random(12_000) < 0.5, rng.integers(1, 300, 12_000), rng.integers(1500, 4000, 12_000))}[lengths]
    sizes: list[int] = []
    pieces = spark.createDataFrame(pd.DataFrame({"_row": np.arange(len(n)), "piece": np.zeros(len(n), np.int32), "length": n}))
    saved = packing.Scratch.save

    def save(self, df):
        out = saved(self, df)
        if "_group" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("_group").count().collect())
        return out

    monkeypatch.setattr(packing.Scratch, "save", save)
    got = packing.pack_pieces(pieces, group_rows=1000, fan=4).toPandas()
    assert len(got) == len(n) and max(sizes) <= 1300 and len(sizes) > 12
    per = got.groupby("sequence_id")["length"].sum()
    assert per.max() <= 4096
    whole = packing.best_fit(np.sort(n)[::-1], tokens=4096, documents=4096, attention=4096.0**2, weights=(1.0, 1e-3, 1e-3), score="norm").max() + 1
    assert len(per) <= whole * 1.01


def _plain_score(machine, rows, terms, n):
    """The sum over terms and over all pairs of terms, by its definition."""
    out = []
    for k in range(n):
        own = [t for r, t in zip(rows, terms, strict=True) if r == k]
        z = machine.bias + sum(machine.weight[t] for t in own) + sum(float(machine.vectors[a] @ machine.vectors[b]) for a, b in itertools.combinations(own, 2))
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def _texts_and_labels(rng, n=30, m=12):
    pairs = [(k, t) for k in range(n) for t in np.flatnonzero(rng.random(m) < 0.35).tolist()]
    rows, terms = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return rows, terms, (rng.random(n) < 0.4).astype(float)


def test_machine_scores_equal_the_sum_over_pairs():
    from bytelens.llm.toxicity import Machine

    rng = np.random.default_rng(6)
    rows, terms, _ = _texts_and_labels(rng)
    machine = Machine(np.arange(12), rng.normal(size=12), rng.normal(size=(12, 3)), 0.3)
    assert np.allclose(machine.score(rows, terms, 31), _plain_score(machine, rows, terms, 31))  # the last text has no terms


def test_a_step_of_training_goes_down_the_slope():
    """The first step moves every number by ``rate`` against the sign of the loss's slope, here by differences."""
    from bytelens.llm.toxicity import Machine, train

    rng = np.random.default_rng(7)
    rows, terms, label = _texts_and_labels(rng)
    n, m, k, ridge = len(label), 12, 3, 2e-4
    share = label.mean()
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    start = np.concatenate([np.zeros((m, 1)), np.random.default_rng(5).normal(0, 0.05, (m, k))], 1)
    bias = float(np.log(share / (1 - share)))

    def loss(w, b):
        p = _plain_score(Machine(np.arange(m), w[:, 0], w[:, 1:], b), rows, terms, n)
        return float((-balance * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean() + ridge / 2 * (w * w).sum())

    made = train(rows, terms, label, np.arange(m), factors=k, steps=1, rate=0.01, ridge=ridge, seed=5)
    moved = np.concatenate([made.weight[:, None], made.vectors], 1) - start
    seen = 0
    for i in range(m):
        for f in range(1 + k):
            up, down = start.copy(), start.copy()
            up[i, f] += 1e-5
            down[i, f] -= 1e-5
            slope = (loss(up, bias) - loss(down, bias)) / 2e-5
            if abs(slope) > 1e-5:
                seen += 1
                assert moved[i, f] == pytest.approx(-0.01 * np.sign(slope), rel=1e-2), (i, f)
    assert seen > 30
    slope = (loss(start, bias + 1e-5) - loss(start, bias - 1e-5)) / 2e-5
    assert made.bias - bias == pytest.approx(-0.01 * np.sign(slope), rel=1e-2)
