"""Set join of one bounded block over a trie of globally ordered sets."""

from __future__ import annotations

import numpy as np


class Trie:
    """Path-compressed trie over sets of ranks, as arrays by level.

    Sets that begin alike share the nodes of their common part. Each node has the ranks on its edge, and the
    least and greatest size of the sets below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        spans: list[tuple[int, int, int, int, int, int]] = []  # parent, from, to, set, first leaf, last leaf
        self.leaves: list[tuple[int, int]] = []
        stack = [(0, len(order), 0, -1)]  # sets order[a:b] agree on their first `depth` ranks
        while stack:
            a, b, depth, parent = stack.pop()
            lead, tail = sets[order[a]], sets[order[b - 1]]
            n = min(len(lead), len(tail))
            apart = np.flatnonzero(lead[depth:n] != tail[depth:n])
            end = depth + int(apart[0]) if len(apart) else n
            node = len(spans)
            spans.append((parent, depth, end, order[a], a, b))
            while a < b and len(sets[order[a]]) == end:
                self.leaves.append((node, order[a]))
                a += 1
            while a < b:
                rank, c = sets[order[a]][end], a + 1
                while c < b and sets[order[c]][end] == rank:
                    c += 1
                stack.append((a, c, end, node))
                a = c
        sizes = np.array([len(sets[i]) for i in order])
        self.parent = np.array([s[0] for s in spans])
        level = np.zeros(len(spans), np.int64)
        for i, p in enumerate(self.parent):  # parents come before their children
            level[i] = level[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(level == d) for d in range(level.max() + 1)]
        self.end = np.array([s[2] for s in spans])
        self.least = np.array([sizes[s[4] : s[5]].min() for s in spans])
        self.most = np.array([sizes[s[4] : s[5]].max() for s in spans])
        edges = [sets[s[3]][s[1] : s[2]] for s in spans]
        self.edge_at = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.last = np.array([e[-1] if len(e) else -1 for e in edges])
        self.leaf_node = np.array([n for n, _ in self.leaves])
        self.leaf_set = np.array([s for _, s in self.leaves])
        self.leaf_size = np.array([len(sets[s]) for _, s in self.leaves])

    def search(self, probe: np.ndarray, member: np.ndarray, need) -> np.ndarray:
        """Sets that share at least need(size of the probe, their size) ranks with the probe.

        member marks the probe's ranks. Overlaps are carried from a node to its children, level by level; a subtree is left
        when its overlap and what remains of either side cannot reach what its smallest set needs.
        """
        overlap = np.full(len(self.parent), -1, np.int64)
        for nodes in self.levels:
            up = self.parent[nodes]
            nodes = nodes[(up < 0) | (overlap[up] >= 0)]
            if not len(nodes):
                break
            n = self.edge_at[nodes + 1] - self.edge_at[nodes]
            ends = np.cumsum(n)
            index = np.arange(ends[-1]) + np.repeat(self.edge_at[nodes] - (ends - n), n)
            sums = np.concatenate([[0], np.cumsum(member[self.edge[index]])])
            up = self.parent[nodes]
            here = np.where(up >= 0, overlap[up], 0) + sums[ends] - sums[ends - n]
            rest = np.minimum(len(probe) - np.searchsorted(probe, self.last[nodes], "right"), self.most[nodes] - self.end[nodes])
            alive = here + rest >= need(len(probe), self.least[nodes])
            overlap[nodes[alive]] = here[alive]
        found = overlap[self.leaf_node]
        return self.leaf_set[(found >= 0) & (found >= need(len(probe), self.leaf_size))]


def join_block(left: list[np.ndarray], right: list[np.ndarray], need) -> list[np.ndarray]:
    """For each left set the right sets that it links with; sets are sorted arrays of token hashes.

    Tokens are put in one order, the commonest of the right side first, so that the trie shares as much as it can.
    """
    tokens, n = np.unique(np.concatenate(right), return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -n))] = np.arange(len(tokens))
    place = lambda s: np.searchsorted(tokens, s)
    trie = Trie([np.sort(rank[place(s)]) for s in right])
    member = np.zeros(len(tokens), bool)
    out = []
    for s in left:
        at = np.minimum(place(s), len(tokens) - 1)
        own = np.sort(rank[at[tokens[at] == s]])
        foreign = len(s) - len(own)
        member[own] = True
        out.append(trie.search(own, member, lambda size, other, f=foreign: need(size + f, other)))
        member[own] = False
    return out
