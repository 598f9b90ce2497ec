"""Exact top-k by integer inner product: best-first search in M-trees.

The largest inner product is the nearest neighbour once every vector x gets one more component
sqrt(M^2 - |x|^2), M being the largest norm of the shard, and queries get 0: then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, a metric. Each shard is an M-tree of two levels of routing
objects over leaf pages. A node holds its routing object, its covering radius and, for every
entry, the distance to the routing object. A query expands the node with the smallest lower
bound; entries whose stored distance already rules them out are not compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.vectors import search, usable

#: Rows of a shard, queries of a block, entries of a page, and pages below an inner node, about.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
PAGE_ROWS = 128
FANOUT = 12


@dataclass
class Node:
    centre: np.ndarray  # the routing object
    radius: float  # covers all that lies below
    entries: np.ndarray  # rows of the shard (leaf) or numbers of nodes (inner)
    parent_distance: np.ndarray  # of the entries, to the routing object
    leaf: bool


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _groups(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, near ones together; equal points are cut anywhere."""
    done, waiting = [], [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        seeds = rows[np.linspace(0, len(rows) - 1, min(len(rows), 2 * (-(-len(rows) // size)))).astype(int)]
        nearest = _distance(points[rows], points[seeds]).argmin(1)
        parts = [rows[nearest == s] for s in range(len(seeds)) if (nearest == s).any()]
        if len(parts) == 1:
            parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        waiting += parts
    return done


class MTree:
    """One shard's tree over integer vectors; ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.vectors = np.floor(64.0 * vectors)
        norms = (self.vectors**2).sum(1)
        self.top = float(norms.max(initial=0))
        points = np.hstack([self.vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.nodes: list[Node] = []
        leaves = [self._node(points, points, rows, np.zeros(len(rows)), True) for rows in _groups(points, PAGE_ROWS)]
        centres = np.array([self.nodes[i].centre for i in leaves])
        radii = np.array([self.nodes[i].radius for i in leaves])
        self.roots = [
            self._node(points, centres, rows, radii[rows], False, np.array(leaves))
            for rows in _groups(centres, FANOUT)
        ]
        self.centres = np.array([n.centre for n in self.nodes])

    def _node(self, points, objects, rows, radii, leaf, names=None) -> int:
        """Add a node whose routing object is the entry nearest to the mean."""
        own = objects[rows]
        centre = own[((own - own.mean(0)) ** 2).sum(1).argmin()]
        distance = _distance(own, centre[None, :])[:, 0]
        entries = rows if leaf else names[rows]
        self.nodes.append(Node(centre, float((distance + radii).max()), entries, distance, leaf))
        return len(self.nodes) - 1

    def scores(self, queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        """Integer inner products: in doubles while these are exact, else in Python integers."""
        if exact:
            return (queries @ self.vectors[rows].T).astype(np.int64)
        as_int = np.vectorize(int, otypes=[object])
        return as_int(queries) @ as_int(self.vectors[rows]).T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
        """Every query goes its own way through the tree; those at the same node go together."""
        queries = np.floor(64.0 * queries)
        n = len(queries)
        lifted = np.hstack([queries, np.zeros((n, 1))])
        constant = (queries**2).sum(1) + self.top
        # Above the rounding of distances: a bound must be larger by this to rule anything out.
        slack = 1e-6 * np.sqrt(constant + 1) + 1e-6
        bound = np.full((n, len(self.nodes)), np.inf)
        to_root = _distance(lifted, self.centres[self.roots])
        radius = np.array([self.nodes[i].radius for i in self.roots])
        bound[:, self.roots] = np.maximum(to_root - radius, 0)
        distance = np.full((n, len(self.nodes)), np.nan)
        distance[:, self.roots] = to_root
        # A key orders by score, then by the smaller id: rows are ascending by id.
        rows_total = len(self.ids)
        largest = max(self.top, (queries**2).sum(1).max(initial=0))
        exact = largest < 2**52 and (largest + 1) * rows_total < 2**62
        worst = -(2**62) if exact else -(2**200)
        best = np.full((n, k), worst, np.int64 if exact else object)
        reach = np.full(n, np.inf)  # distance of the k-th best
        alive = np.arange(n)
        while len(alive):
            node_of = bound[alive].argmin(1)
            lowest = bound[alive, node_of]
            keep = np.isfinite(lowest) & (lowest <= reach[alive] + slack[alive])
            alive, node_of = alive[keep], node_of[keep]
            for name in np.unique(node_of):
                who, node = alive[node_of == name], self.nodes[name]
                bound[who, name] = np.inf
                own = distance[who, name][:, None]
                apart = np.abs(own - node.parent_distance[None, :])
                limit = (reach[who] + slack[who])[:, None]
                if not node.leaf:
                    radius = np.array([self.nodes[i].radius for i in node.entries])
                    possible = (apart - radius <= limit).any(0)
                    children, radius = node.entries[possible], radius[possible]
                    if len(children):
                        to_child = _distance(lifted[who], self.centres[children])
                        distance[np.ix_(who, children)] = to_child
                        bound[np.ix_(who, children)] = np.maximum(to_child - radius, 0)
                    continue
                rows = node.entries[(apart <= limit).any(0)]
                if not len(rows):
                    continue
                keys = self.scores(queries[who], rows, exact) * rows_total + (rows_total - 1 - rows)
                keys[self.ids[rows][None, :] == query_ids[who][:, None]] = worst
                some = (keys > best[who, 0][:, None]).any(1)
                who, keys = who[some], keys[some]
                if len(who):
                    merged = np.sort(np.hstack([best[who], keys]), axis=1)[:, -k:]
                    best[who] = merged  # ascending: the k-th best comes first
                    kth = np.floor_divide(merged[:, 0], rows_total).astype(float)
                    square = np.maximum(constant[who] - 2 * kth, 0)
                    reach[who] = np.where(merged[:, 0] == worst, np.inf, np.sqrt(square))
        found = best != worst
        query, _ = np.nonzero(found)
        keys = best[found]
        score = np.floor_divide(keys, rows_total)
        rows = (rows_total - 1 - (keys - score * rows_total)).astype(np.int64)
        yield query_ids[query], self.ids[rows], score.astype(np.int64)


def top_k(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` largest inner products of each query row with all other rows, exactly.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are the rows with
    another ``vec_id``. Components become floor(64 x). Ties go to the smaller id; repeated rows
    count as often as they occur, and a query id that occurs repeatedly gets its ranks over
    all its rows. Null vectors, null ids and vectors with null or non-finite components take no
    part, nor do those whose inner product with themselves does not fit the 64 bits of a score (no
    product of the others exceeds that). Vectors are compared with those of their own length. An
    empty table gives no rows.
    """
    square = F.aggregate("vec", F.lit(0.0), lambda sum, x: sum + F.pow(F.floor(F.lit(64.0) * x).cast("double"), 2))
    return search(
        usable(rows).where(square < 2.0**63),
        F.col("vec_id") % every == 0,
        SHARD_ROWS,
        BLOCK_ROWS,
        lambda ids, vectors: pickle.dumps(MTree(ids, vectors)),
        pickle.loads,
        lambda tree, ids, vectors: tree.search(ids, vectors, k),
        k,
        "long",
        F.desc("score"),
    )
