"""Queries and operators that must take the whole of their input."""

from __future__ import annotations

import os

import numpy as np
import pytest

from bytelens.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def _embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)


@tables
def test_graph_knn_recall(spark):
    ids, x = _embeddings(spark)
    got: dict = {}
    for r in catalog.QUERIES["graph_knn"](spark, SF).collect():
        got.setdefault(r["id"], []).append(r["key"])
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(got) == {ids[i] for i in asked}
    hits = sum(len({ids[j] for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:5]} & set(got[ids[i]])) for i in asked)
    assert hits >= 0.9 * 5 * len(asked)


def test_graph_files_hold_every_row(spark):
    from bytelens.sources.files import graph_files, graph_nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, [1.0, 2.0]), (701, [1.0, 3.0]), (702, None), (703, [None] * 8), (704, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    files = graph_files(df, part=100).persist()
    held = [i for r in files.collect() for i in np.frombuffer(r["ids"], "<i8").tolist()]
    assert sorted(held) == [*range(600), 700, 701] and files.where("dim = 8").count() > 3
    got: dict = {}
    for r in graph_nearest(df, files, k=5, block=200).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["key"])
    want = {i: [j for _, j in sorted((float(d), j) for j, d in enumerate(((x.astype(float) - x[i]) ** 2).sum(1)))[:5]] for i in range(600)}
    assert set(got) == {*range(600), 700, 701} and got[700] == [700, 701]
    assert sum(len(set(got[i]) & set(want[i])) for i in range(600)) >= 0.97 * 3000


@tables
def test_graph_orders_take_every_edge(spark):
    from pyspark.sql import functions as F

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = {(r[0] + 10_000_000, r[1]) for r in lines.select("l_suppkey", "l_partkey").collect()}
    got = [tuple(r) for r in catalog._edges(spark, SF).select("src", "dst").collect()]
    assert len(got) == len(want) and set(got) == want
    ends = {x for e in want for x in e}
    for name in ("rcm_order", "community_order"):
        o = catalog.QUERIES[name](spark, SF)
        assert {r["id"] for r in o.collect()} == ends and o.agg(F.countDistinct("new_id")).first()[0] == len(ends)


@tables
def test_hilbert_permutation_orders_whole_vectors(spark, monkeypatch):
    from bytelens.functions import orders
    from bytelens.operators import content

    made, plain = [], content.hilbert_order
    monkeypatch.setattr(content, "hilbert_order", lambda *a, **b: made.append(plain(*a, **b)) or made[-1])
    catalog.QUERIES["hilbert_permutation"](spark, SF).collect()
    ids, x = _embeddings(spark)
    x = x.astype(np.float32)
    keys = orders.hilbert_keys(orders.quantize(x, x.min(0), x.max(0), 16), 16)
    assert [r["id"] for r in made[0].orderBy("new_id").collect()] == [i for _, i in sorted(zip(keys, ids, strict=True))]


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_nearest_takes_every_query(spark, metric):
    from bytelens.operators.neighbours import nearest

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=(10, 3))
    rows = [(100 + i, v.tolist()) for i, v in enumerate(y)] + [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0, None, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest(df, df, 3, metric, most=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])

    def far(a, b):
        return {"l2": np.sqrt(((a - b) ** 2).sum()), "cosine": 1 - a @ b / np.sqrt((a @ a) * (b @ b)), "inner_product": -(a @ b)}[metric]

    for m, first in ((x, 0), (y, 100)):
        for i, a in enumerate(m):
            assert got.pop(first + i) == [first + j for _, j in sorted((far(a, b), j) for j, b in enumerate(m))[:3]]
    assert not got
