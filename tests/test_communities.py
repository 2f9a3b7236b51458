"""Communities in rounds against the sequential order's forest."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bytelens.operators import communities as cm
from bytelens.operators.graphs import check_permutation
from bytelens.scratch import Scratch

SF = "/root/testdata/sf0.001"


def plain_modularity(edges, label):
    m = len(edges)
    inside = sum(label[a] == label[b] for a, b in edges)
    degree = Counter(label[x] for e in edges for x in e)
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


def sequential(edges):
    """The communities that merging one vertex at a time ends with: lowest degree first, into the neighbour it gains most with."""
    adj, names = {}, sorted({x for e in edges for x in e})
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            adj.setdefault(x, Counter())[y] += 1
    degree = {v: sum(adj[v].values()) for v in names}
    total, to = sum(degree.values()), {}
    live = set(names)
    import heapq

    queue = [(degree[v], v) for v in names]
    heapq.heapify(queue)
    while queue:
        d, u = heapq.heappop(queue)
        if u not in live or d != degree[u]:
            continue
        gain, v = max(((total * w - degree[u] * degree[v], -v) for v, w in adj[u].items()), default=(0, 0))
        if gain <= 0:
            continue
        v = -v
        to[u] = v
        live.discard(u)
        for x, w in adj.pop(u).items():
            del adj[x][u]
            if x != v:
                adj[v][x] += w
                adj[x][v] += w
        degree[v] += degree[u]
        heapq.heappush(queue, (degree[v], v))

    def root(x):
        while x in to:
            x = to[x]
        return x

    return {v: root(v) for v in names}


def planted(rng, groups, size, inside, across):
    nodes = [(g, k) for g in range(groups) for k in range(size)]
    edges = set()
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if rng.random() < (inside if a[0] == b[0] else across):
                edges.add((a[0] * 1000 + a[1], b[0] * 1000 + b[1]))
    return sorted(edges)


def held(spark, edges):
    df = spark.createDataFrame([(*e,) for e in edges], "src long, dst long")
    out = cm.communities(df, Scratch(spark)).persist()
    check_permutation(out)
    label = {r["id"]: r["community"] for r in out.collect()}
    assert set(label) == {x for a, b in edges if a != b for x in (a, b)}
    place = {r["id"]: r["new_id"] for r in out.collect()}
    for c in set(label.values()):  # a community stands together, its name first
        own = sorted(place[v] for v, x in label.items() if x == c)
        assert own == list(range(own[0], own[0] + len(own))) and place[c] == own[0]
    q = cm.modularity(df, out.select("id", "community")).first()[0]
    assert q == pytest.approx(plain_modularity([e for e in edges if e[0] != e[1]], label))
    return q, label


def test_planted_groups_hubs_copies_and_loops(spark):
    edges = planted(random.Random(5), 6, 18, 0.5, 0.02)
    edges += [(50_000, 50_000 + k) for k in range(1, 200)]
    edges += [(60_000 + k, 60_000 + (k + 1) % 40) for k in range(40)] * 2
    q, label = held(spark, [*edges, (3, 3), (99_999, 99_999)])
    assert q >= 0.95 * plain_modularity(edges, sequential(edges)) > 0.4 and 99_999 not in label
    assert len({label[50_000 + k] for k in range(200)}) == 1
    assert cm.communities(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_parts_and_suppliers(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    df = lines.select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    edges = [tuple(r) for r in df.collect()]
    q, _ = held(spark, edges)
    assert q >= 0.95 * plain_modularity(edges, sequential(edges))
