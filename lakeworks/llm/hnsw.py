"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Equal vectors of a shard are one node with many members, so a common vector cannot cut the
graph apart. Nodes are inserted in a random order, each with a level drawn for it; level l
links the nodes that reach it. A node is linked to the nearest of those inserted before it (found
exactly, a block of rows at a time), thinned so that a link is kept only if no kept neighbour is
nearer to the candidate. The links back are thinned in the same way, so early nodes keep the long
links between regions, and what a layer's first node would not reach gets a link more. Links are
one flat array per layer. A shard's graph is built once and written; a search descends
greedily and explores the ground layer with the ``breadth`` best nodes seen; scores are
computed on the original vectors.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.vectors import search, usable

#: Rows of a shard and queries of a block, about.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: Links of a node (twice on the ground layer), candidates for them, nodes a search keeps.
LINKS = 12
CANDIDATES = 48
BREADTH = 80


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def _earlier(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest of those before it, nearest first; infinitely far where there are fewer."""
    n = len(points)
    count = min(count, n)
    order = np.empty((n, count), np.int32)
    squares = np.empty((n, count))
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        d = _squares(points[rows], points)
        d[rows[:, None] <= np.arange(n)] = np.inf
        some = np.argpartition(d, count - 1, axis=1)[:, :count]
        own = np.take_along_axis(d, some, 1)
        ranked = np.argsort(own, axis=1, kind="stable")
        order[rows] = np.take_along_axis(some, ranked, 1)
        squares[rows] = np.take_along_axis(own, ranked, 1)
    return order, squares


def _thinned(points: np.ndarray, near: np.ndarray, squares: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those that no kept one is nearer to than the node is; at most ``most``."""
    between = _squares(points[near], points[near])
    free = np.ones(len(near), bool)
    chosen: list[int] = []
    for c in range(len(near)):
        if free[c]:
            chosen.append(c)
            if len(chosen) == most:
                break
            free &= between[c] >= squares
    return near[chosen]


def _layer(points: np.ndarray, width: int) -> np.ndarray:
    """Neighbours of each point in a flat array, a row per point, -1 where there are fewer.

    Rows hold ``width`` links, and as many more as it takes to reach every point from the first.
    """
    n = len(points)
    near, squares = _earlier(points, CANDIDATES)
    links: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        there = np.isfinite(squares[i])
        for j in _thinned(points, near[i][there], squares[i][there], width // 2).tolist():
            links[i].append(j)
            links[j].append(i)
    kept = []
    for i in range(n):
        own = np.array(links[i], np.int32)
        if len(own) > width:
            away = _squares(points[i][None], points[own])[0]
            nearest = np.argsort(away, kind="stable")
            own = _thinned(points, own[nearest], away[nearest], width)
        kept.append(own.tolist())
    reached = np.zeros(n, bool)
    for i in range(n):
        if reached[i]:
            continue
        if i:
            # Its own links lead to earlier points, all of them reached by now.
            kept[near[i, 0]].append(i)
        waiting = [i]
        reached[i] = True
        while waiting:
            for j in kept[waiting.pop()]:
                if not reached[j]:
                    reached[j] = True
                    waiting.append(j)
    flat = np.full((n, max(map(len, kept))), -1, np.int32)
    for i, own in enumerate(kept):
        flat[i, : len(own)] = own
    return flat


class Graph:
    """The layers over one shard's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        points, member = np.unique(vectors, axis=0, return_inverse=True)
        chance = np.random.default_rng(0)
        inserted = chance.permutation(len(points))
        self.points = points[inserted]
        member = np.argsort(inserted)[member.reshape(-1)]
        self.by_node = np.argsort(member, kind="stable")  # ids stay ascending in a node
        self.first = np.concatenate([[0], np.cumsum(np.bincount(member))])
        level = np.floor(-np.log(1 - chance.random(len(points))) / np.log(LINKS)).astype(int)
        level[0] = level.max()  # where searches enter
        self.nodes = [np.flatnonzero(level >= height) for height in range(level.max() + 1)]
        self.links = [
            _layer(self.points[nodes], LINKS * (2 if height == 0 else 1)) for height, nodes in enumerate(self.nodes)
        ]
        self._place()

    def _place(self) -> None:
        self.place = []
        for nodes in self.nodes:
            place = np.full(len(self.points), -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.place.append(place)
        self.entry = 0

    def dump(self) -> bytes:
        """The flat arrays as one value."""
        layers = {f"nodes{h}": x for h, x in enumerate(self.nodes)} | {f"links{h}": x for h, x in enumerate(self.links)}
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points, by_node=self.by_node, first=self.first, **layers)
        return out.getvalue()

    @classmethod
    def load(cls, value: bytes) -> Graph:
        graph = cls.__new__(cls)
        with np.load(io.BytesIO(value), allow_pickle=False) as stored:
            for name in ("ids", "points", "by_node", "first"):
                setattr(graph, name, stored[name])
            layers = range(sum(name.startswith("nodes") for name in stored.files))
            graph.nodes = [stored[f"nodes{h}"] for h in layers]
            graph.links = [stored[f"links{h}"] for h in layers]
        graph._place()
        return graph

    def _around(self, height: int, node: int) -> np.ndarray:
        own = self.links[height][self.place[height][node]]
        return self.nodes[height][own[own >= 0]]

    def _square(self, query: np.ndarray, nodes) -> np.ndarray:
        gap = self.points[nodes] - query
        return np.einsum("ij,ij->i", gap, gap)

    def nearest_nodes(self, query: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        node = self.entry
        best = float(self._square(query, [node])[0])
        for height in range(len(self.nodes) - 1, 0, -1):
            while len(around := self._around(height, node)):
                squares = self._square(query, around)
                if squares.min() >= best:
                    break
                node, best = int(around[squares.argmin()]), float(squares.min())
        seen = np.zeros(len(self.points), bool)
        seen[node] = True
        waiting, kept = [(best, node)], [(-best, node)]
        while waiting:
            square, node = heapq.heappop(waiting)
            if len(kept) == breadth and square > -kept[0][0]:
                break
            around = self._around(0, node)
            around = around[~seen[around]]
            seen[around] = True
            if not len(around):
                continue
            for square, other in zip(self._square(query, around).tolist(), around.tolist()):
                if len(kept) < breadth:
                    heapq.heappush(kept, (-square, other))
                elif square < -kept[0][0]:
                    heapq.heapreplace(kept, (-square, other))
                else:
                    continue
                heapq.heappush(waiting, (square, other))
        return sorted((-s, node) for s, node in kept)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
        query, rows, scores = [], [], []
        for query_id, vector in zip(query_ids.tolist(), queries):
            found = 0
            last = -1.0
            for square, node in self.nearest_nodes(vector, max(BREADTH, k + 1)):
                if found >= k and square > last:
                    break  # nodes at the same distance still compete by id
                # Ids ascend, and members by place: the query's own rows lie side by side.
                own = self.by_node[self.first[node] : self.first[node + 1]]
                low, high = np.searchsorted(own, np.searchsorted(self.ids, [query_id, query_id + 1]))
                own = np.concatenate([own[: min(low, k)], own[high : high + k]])[:k]
                query += [query_id] * len(own)
                rows += own.tolist()
                scores += [float(np.sqrt(square))] * len(own)
                found += len(own)
                last = square
        yield np.array(query, np.int64), self.ids[np.array(rows, np.int64)], np.array(scores, float)


def nearest(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest other rows found for each query row, by Euclidean distance.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates have another
    ``vec_id``. Ties go to the smaller id. Null and zero vectors, null ids and vectors with null
    or non-finite components take no part; vectors are compared with those of their own
    length. Repeated rows are neighbours as often as they occur. An empty table gives no rows.
    """
    some = usable(rows)
    return search(
        some.where(F.exists("vec", lambda x: x != 0)),
        F.col("vec_id") % every == 0,
        SHARD_ROWS,
        BLOCK_ROWS,
        lambda ids, vectors: Graph(ids, vectors).dump(),
        Graph.load,
        lambda graph, ids, vectors: graph.search(ids, vectors, k),
        k,
        "double",
        F.asc("score"),
    )
