"""BK-trees over 64-bit fingerprints, built and searched for many shards at once.

A child's key is its integer Hamming distance to its parent.  Trees of all the
shards in hand are one forest in arrays: building goes down one level a step,
and a search holds (query, node) pairs, measures them together, and follows only
edges whose key is within the radius of the distance found.
"""

from __future__ import annotations

import numpy as np

_SPAN = 65  # distances 0 to 64


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree for each run of equal ``shard``; ``shard`` must be sorted."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        new = np.ones(n, bool)
        new[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        rest = np.flatnonzero(~new)
        at = self.root[rest]
        edges, nodes = [], []
        while len(rest):
            key = at * _SPAN + hamming(values[rest], values[at])
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append(key[first])
            nodes.append(rest[first])
            child = rest[first][back]
            stay = child != rest
            rest, at = rest[stay], child[stay]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edge = key[order]
        self.node = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def links(self, radius: int, pairs_at_once: int = 2_000_000) -> "list[tuple[np.ndarray, np.ndarray]]":
        """Index pairs (query, smaller index) at most ``radius`` apart within their shard, by chunks of queries."""
        from .tokens import ragged

        found = []
        query = np.flatnonzero(self.root != np.arange(len(self.root)))
        step = max(1, pairs_at_once // 64)
        for a in range(0, len(query), step):
            q = query[a : a + step]
            at = self.root[q]
            while len(q):
                d = hamming(self.values[q], self.values[at])
                hit = (d <= radius) & (at < q)
                if hit.any():
                    found.append((q[hit], at[hit]))
                low = np.searchsorted(self.edge, at * _SPAN + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.edge, at * _SPAN + np.minimum(d + radius, 64), "right")
                many = high - low
                q, at = np.repeat(q, many), self.node[ragged(low, many)]
        return found


def settle(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n items over index pairs."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)  # roots move with their members
        label = label[label]
        if (label == before).all():
            return label


def dense(values: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of one shard too large for a tree search of all its pairs.

    Each item, once reached, is compared with the items not reached yet, and
    leaves the shard: a cluster of near copies is gone after a few comparisons.
    """
    label, left = np.full(len(values), -1), np.arange(len(values))
    while len(left):
        start = left[0]
        label[start], left, front = start, left[1:], [start]
        while front and len(left):
            near = hamming(values[left], values[front.pop()]) <= radius
            if near.any():
                reached = left[near]
                label[reached] = start
                front.extend(reached.tolist())
                left = left[~near]
    return label
