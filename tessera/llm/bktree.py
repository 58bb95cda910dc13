"""BK-trees over 64-bit fingerprints, many trees at once and vectorised.

A node's children are keyed by their integer Hamming distance to it. A query at distance d from a node follows only the
edges with keys from d - radius to d + radius. The trees of many groups are built and searched level by level together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of query and node that are open at once.
FRONTIER = 1 << 21


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for each group; ``groups`` must be sorted, and a group's first row is its root."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray) -> None:
        self.prints = prints.astype(np.uint64)
        n = len(prints)
        first = np.ones(n, bool)
        first[1:] = groups[1:] != groups[:-1]
        self.roots = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        parents, keys, children = [], [], []
        rows, cluster = np.flatnonzero(~first), self.roots[~first]  # rows that wait below a node
        while len(rows):
            key = distance(self.prints[rows], self.prints[cluster])
            order = np.lexsort((rows, key, cluster))
            rows, key, cluster = rows[order], key[order], cluster[order]
            head = np.ones(len(rows), bool)
            head[1:] = (cluster[1:] != cluster[:-1]) | (key[1:] != key[:-1])
            parents.append(cluster[head])
            keys.append(key[head])
            children.append(rows[head])
            below = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
            rows, cluster = rows[~head], below[~head]
        edge = np.concatenate(parents) * 128 + np.concatenate(keys) if parents else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edges = edge[order]
        self.children = np.concatenate(children)[order] if children else edge

    def within(self, prints: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and nodes at most ``radius`` bits apart; each query searches the tree of its root."""
        query, node = np.arange(len(prints)), roots
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            d = distance(prints[query], self.prints[node])
            near = d <= radius
            found.append((query[near], node[near]))
            low = np.searchsorted(self.edges, node * 128 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.edges, node * 128 + d + radius, "right") - low
            query = np.repeat(query, count)
            offset = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            node = self.children[np.repeat(low, count) + offset]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def neighbours(forest: Forest, prints: np.ndarray, roots: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``within`` in blocks of queries, so that a block's open pairs stay within FRONTIER even if all nodes are visited.

    sizes: nodes in the tree of each query. The first blocks are small: what they link need not be linked again.
    """
    start, most = 0, 8
    total = np.cumsum(sizes)
    while start < len(prints):
        before = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, before + FRONTIER, "right"))
        stop = min(max(stop, start + 1), start + most, len(prints))
        a, b = forest.within(prints[start:stop], roots[start:stop], radius)
        yield a + start, b
        start, most = stop, most * 4


class Union:
    """Disjoint sets of row numbers with vectorised look-up."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while True:
            up = self.parent[at]
            if (up == at).all():
                self.parent[rows] = at
                return at
            at = up

    def join(self, a: int, b: int) -> bool:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a == b:
            return False
        parent[max(a, b)] = min(a, b)
        return True

    def join_all(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Joins all pairs; yields those that joined two sets: a spanning forest."""
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            apart = self.roots(x) != self.roots(y)
            for u, v in zip(x[apart].tolist(), y[apart].tolist()):
                if self.join(u, v):
                    yield u, v
