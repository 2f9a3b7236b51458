"""Reading and searching a serialized layered neighbour graph (the usearch 2.25 file layout), and building a small one."""

from __future__ import annotations

import bisect
import struct
from dataclasses import dataclass

import numpy as np

# Metric and scalar codes of the head.
METRICS = {"i": "inner_product", "c": "cosine", "e": "l2_squared", "b": "hamming", "t": "tanimoto", "j": "jaccard"}
SCALARS = {1: "b1x8", 11: "f32", 17: "u8", 23: "i8"}
MAGIC = b"usearch"


class GraphError(ValueError):
    pass


@dataclass
class Graph:
    keys: np.ndarray
    vectors: np.ndarray  # rows of bytes
    levels: np.ndarray
    links: list[list[list[int]]]  # of each node, of each layer
    entry: int
    metric: str
    scalar: str

    @property
    def top(self) -> int:
        return int(self.levels[self.entry]) if len(self.levels) else 0

    def neighbours(self, node: int, layer: int) -> list[int]:
        return self.links[node][layer] if layer < len(self.links[node]) else []


def write(keys: list[int], vectors: np.ndarray, links: list[list[list[int]]], entry: int, *, metric: str = "e", scalar: int = 11, connectivity: int = 16) -> bytes:
    rows, width = vectors.view(np.uint8).reshape(len(keys), -1).shape
    base = 2 * connectivity
    head = bytearray(64)
    head[:7] = MAGIC
    struct.pack_into("<HHH", head, 7, 2, 25, 0)
    head[13], head[14], head[15], head[16] = ord(metric), scalar, 14, 15
    struct.pack_into("<QQQ", head, 17, rows, 0, vectors.shape[1])
    top = max((len(x) for x in links), default=1) - 1
    out = [struct.pack("<II", rows, width), vectors.tobytes(), bytes(head), struct.pack("<5Q", rows, connectivity, base, top, entry)]
    out.append(np.array([len(x) - 1 for x in links], "<i2").tobytes())
    for key, layers in zip(keys, links, strict=True):
        out.append(struct.pack("<qh", key, len(layers) - 1))
        for k, x in enumerate(layers):
            room = base if k == 0 else connectivity
            out.append(struct.pack("<I", len(x)) + np.array([*x, *[0] * (room - len(x))], "<u4").tobytes())
    return b"".join(out)


def _near(x: np.ndarray, n: int) -> np.ndarray:
    """Of each row the n nearest others, nearest first, exactly but for single precision."""
    x = x.astype(np.float32)
    x = x - x.mean(0)
    norm, out = (x * x).sum(1), np.empty((len(x), n), np.int64)
    for at in range(0, len(x), 1024):
        d = norm - 2 * (x[at : at + 1024] @ x.T)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(x) else np.argsort(d, axis=1)[:, :n]
        out[at : at + 1024] = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
    return out


def build(vectors: np.ndarray, connectivity: int = 16) -> tuple[list[list[list[int]]], int]:
    """(links, entry) of distinct f32 rows by exact neighbours: a layer holds one node in ``connectivity`` of the layer below.

    Half of a node's links go to its nearest, up to 5 of 16 back to those it is nearest to, fewest ways in first,
    and the rest along random cycles through the layer, so that every node can be reached.
    """
    n, rng = len(vectors), np.random.default_rng(len(vectors))
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(connectivity)).astype(int), 8)
    links: list[list[list[int]]] = [[] for _ in range(n)]
    for layer in range(int(levels.max(initial=0)) + 1):
        at = np.flatnonzero(levels >= layer)
        room = connectivity * (2 if layer == 0 else 1)
        if len(at) <= room + 1:
            for i in at.tolist():
                links[i].append([j for j in at.tolist() if j != i])
            continue
        near = _near(vectors[at], room // 2)
        ways = np.bincount(near.ravel(), minlength=len(at))
        v, u = np.repeat(np.arange(len(at)), near.shape[1]), near.ravel()
        order = np.lexsort((np.tile(np.arange(near.shape[1]), len(at)), ways[v], u))
        back = np.split(v[order], np.cumsum(ways)[:-1])
        cycles = [rng.permutation(len(at)) for _ in range(room - room // 2 - room * 5 // 16)]
        far = np.empty((len(at), len(cycles)), np.int64)
        for c, p in enumerate(cycles):
            far[p, c] = np.roll(p, -1)
        for k, i in enumerate(at.tolist()):
            own = near[k].tolist()
            mine = [*own, *[x for x in back[k].tolist() if x not in own][: room * 5 // 16], *far[k].tolist()]
            links[i].append(at[list(dict.fromkeys(mine))].tolist())
    return links, int(levels.argmax()) if n else 0


def read(raw: bytes, scalars: dict[int, str] = SCALARS) -> Graph:
    """Raises GraphError where the file is cut off or contradicts itself."""
    try:
        rows, width = struct.unpack_from("<II", raw)
        at = 8 + rows * width
        head = raw[at : at + 64]
        if head[:7] != MAGIC:
            raise GraphError("no graph file")
        if struct.unpack_from("<HH", head, 7) != (2, 25):
            raise GraphError("another version")
        if head[15] != 14 or head[16] != 15 or head[41]:
            raise GraphError("keys must be single 64-bit numbers, slots 32-bit ones")
        if not struct.unpack_from("<Q", head, 33)[0]:
            raise GraphError("no dimensions")
        size, m, base, top, entry = struct.unpack_from("<5Q", raw, at + 64)
        if size != rows or m < 2 or base < m or (rows and entry >= rows):
            raise GraphError("the graph's head contradicts itself")
        at += 104
        levels = np.frombuffer(raw, "<i2", rows, at)
        at += 2 * rows
        if rows and levels[entry] != top:
            raise GraphError("the entry isn't on the top layer")
        keys, links = [], []
        for level in levels.tolist():
            key, own = struct.unpack_from("<qh", raw, at)
            at += 10
            if own != level or level < 0:
                raise GraphError("two levels for one node")
            layers = []
            for k in range(level + 1):
                room = base if k == 0 else m
                n = struct.unpack_from("<I", raw, at)[0]
                if n > room:
                    raise GraphError("too many neighbours")
                x = np.frombuffer(raw, "<u4", room, at + 4)[:n].tolist()
                if any(y >= rows for y in x):
                    raise GraphError("a neighbour that isn't there")
                layers.append(x)
                at += 4 + 4 * room
            keys.append(key), links.append(layers)
    except struct.error as e:
        raise GraphError("the file is cut off") from e
    vectors = np.frombuffer(raw, np.uint8, rows * width, 8).reshape(rows, width)
    return Graph(np.array(keys, np.int64), vectors, levels, links, int(entry), METRICS.get(chr(head[13]), "?"), scalars.get(head[14], "?"))


_TYPES = {"f32": "<f4", "i8": "i1", "u8": "u1"}


def distance(g: Graph, query: bytes, nodes: list[int]) -> list[float]:
    q, v = np.frombuffer(query, np.uint8), g.vectors[nodes]
    if g.scalar == "b1x8" and g.metric in ("hamming", "jaccard", "tanimoto"):
        if g.metric == "hamming":
            return np.bitwise_count(q ^ v).sum(1).astype(float).tolist()
        both, either = np.bitwise_count(q & v).sum(1), np.bitwise_count(q | v).sum(1)
        return np.where(either == 0, 0.0, 1 - both / np.maximum(either, 1)).tolist()
    if g.scalar not in _TYPES or g.metric not in ("l2_squared", "cosine", "inner_product"):
        raise GraphError(f"no distance for {g.metric} of {g.scalar}")
    x, y = q.view(_TYPES[g.scalar]).astype(float), np.ascontiguousarray(v).view(_TYPES[g.scalar]).astype(float)
    if g.metric == "l2_squared":
        return ((y - x) ** 2).sum(1).tolist()
    if g.metric == "inner_product":
        return (-(y @ x)).tolist()
    n = np.sqrt((x @ x) * (y * y).sum(1))
    if (n == 0).any():
        raise GraphError("the cosine of a zero vector")
    return (1 - y @ x / n).tolist()


def selectivity(g: Graph, permits: set[int]) -> float:
    """The share of the nodes that a filter lets through; 0 of an empty graph."""
    return len([n for n in permits if 0 <= n < len(g.keys)]) / len(g.keys) if len(g.keys) else 0.0


def select(candidates: list[tuple[float, int]], m: int) -> list[tuple[float, int]]:
    """The m nearest of (distance, node), ties by node."""
    return sorted(candidates)[:m]


def _layer(g: Graph, query: bytes, start: tuple[float, int], layer: int, ef: int, permits) -> list[tuple[float, int]]:
    """The ef nearest found; both queues are sorted, hold ef at most and break ties by node."""
    seen, ahead = {start[1]}, [start]
    near = [start] if permits is None or start[1] in permits else []
    while ahead:
        d, node = ahead.pop(0)
        if len(near) >= ef and d > near[-1][0]:
            break
        new = [x for x in dict.fromkeys(g.neighbours(node, layer)) if x not in seen]
        seen.update(new)
        for x, dist in zip(new, distance(g, query, new) if new else [], strict=True):
            if len(near) < ef or dist < near[-1][0]:
                bisect.insort(ahead, (dist, x))
                del ahead[ef:]
                if permits is None or x in permits:
                    bisect.insort(near, (dist, x))
                    del near[ef:]
    return near


def search(g: Graph, query: bytes, k: int, ef: int = 64, permits: set[int] | None = None) -> list[tuple[int, float]]:
    """(key, distance) of the k nearest found; a filter holds for results, not for the way to them."""
    if k < 1:
        raise GraphError("k must be 1 or more")
    if len(query) != g.vectors.shape[1]:
        raise GraphError("the query has another length")
    if not len(g.keys):
        return []
    best = (distance(g, query, [g.entry])[0], g.entry)
    for layer in range(g.top, 0, -1):
        best = (_layer(g, query, best, layer, 1, None) or [best])[0]
    found = _layer(g, query, best, 0, max(ef, k), permits)
    return [(int(g.keys[n]), d) for d, n in found[:k]]
