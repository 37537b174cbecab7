"""BK-trees over 64-bit fingerprints, whole forests at a time in NumPy.

A node's children are keyed by their integer Hamming distance to it. All
fingerprints in the subtree behind edge k of a node are k bits away from that
node, so a search with radius r that is d bits away follows only the edges
d - r to d + r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGES = 65  # distances 0 to 64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for each shard; ``shards`` are numbers from 0 without gaps.

    Trees grow level by level: of all fingerprints that wait at the same edge
    the first becomes the node there, the others move on to its edges.
    """

    def __init__(self, prints: np.ndarray, shards: np.ndarray):
        self.prints = prints
        n_shards = int(shards.max()) + 1 if len(shards) else 0
        self.roots = np.full(n_shards, -1, dtype=np.int64)
        waiting, edge = np.arange(len(prints)), shards.astype(np.int64)
        keys, nodes, top = [], [], True
        while len(waiting):
            slots, first, slot_of = np.unique(edge, return_index=True, return_inverse=True)
            placed = waiting[first]
            if top:
                self.roots[slots] = placed
            else:
                keys.append(slots)
                nodes.append(placed)
            rest = np.ones(len(waiting), dtype=bool)
            rest[first] = False
            waiting, parent, top = waiting[rest], placed[slot_of[rest]], False
            edge = parent * EDGES + distance(prints[waiting], prints[parent])
        found = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(found)
        self.keys = found[order]
        self.nodes = np.concatenate(nodes)[order] if nodes else found

    def within(self, prints: np.ndarray, shards: np.ndarray, radius: int, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node index) of every node of the query's shard that is
        at most ``radius`` bits away, a chunk of queries at a time."""
        for at in range(0, len(prints), chunk):
            query = np.arange(at, min(at + chunk, len(prints)))
            node = self.roots[shards[query]]
            query, node = query[node >= 0], node[node >= 0]
            while len(query):
                d = distance(prints[query], self.prints[node])
                hit = d <= radius
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * EDGES + np.maximum(d - radius, 0))
                n = np.searchsorted(self.keys, node * EDGES + np.minimum(d + radius, EDGES - 1), "right") - low
                query = np.repeat(query, n)
                node = self.nodes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(query))] if len(query) else query


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (a smaller or equal index of the same group for every index)
    after the links a-b, again pointing straight at each group's smallest."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root
