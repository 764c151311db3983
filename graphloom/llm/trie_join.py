"""A prefix-tree join of n-gram sets that fit in memory together.

The n-grams of a block get one global order, frequent first. Each set is a path in a radix tree, so sets that
begin alike share nodes. A query walks the tree level by level: a node's n-grams are counted once for all sets
below it, and a subtree goes as soon as its remaining lengths can't reach the overlap that the threshold asks
for, its set sizes don't fit, or it has no set of another component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trie:
    """Nodes in preorder. A node's n-grams are tokens[seg[i]:seg[i + 1]]; sets are numbered in tree order."""

    order: np.ndarray  # set number in the input, by position in the tree
    tokens: np.ndarray
    seg: np.ndarray
    first: np.ndarray  # position of the first set below each node, ...
    stop: np.ndarray  # ... after the last one, ...
    own: np.ndarray  # ... and after the last one that ends at the node
    child: list[np.ndarray]
    roots: np.ndarray
    left: np.ndarray  # most n-grams that a set below has after the node
    last: np.ndarray  # rank of the node's last n-gram
    small: np.ndarray  # least and greatest whole size of the sets below
    large: np.ndarray


def rank_sets(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set as ascending ranks, frequent n-grams first; n-grams of one set only are left out."""
    sizes = [len(s) for s in sets]
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    shared = int((counts > 1).sum())
    out, at = [], 0
    for n in sizes:
        r = np.sort(rank[inverse[at : at + n]])
        out.append(r[: np.searchsorted(r, shared)])
        at += n
    return out


def build(ranks: list[np.ndarray], sizes: np.ndarray) -> Trie:
    order = np.array(sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">i8").tobytes()), np.int64)
    paths = [ranks[i] for i in order]
    nodes: list[list[int]] = []  # [set whose path it is on, start, end, parent, first set, stop, own sets]
    stack: list[int] = []
    for i, p in enumerate(paths):
        common = 0
        if i:
            q = paths[i - 1]
            m = min(len(p), len(q))
            differ = np.flatnonzero(p[:m] != q[:m])
            common = int(differ[0]) if len(differ) else m
        while stack and nodes[stack[-1]][1] >= common and not (nodes[stack[-1]][2] == common):
            nodes[stack.pop()][5] = i
        if stack and nodes[stack[-1]][2] > common:  # split: the upper part becomes a node of its own
            low = stack.pop()
            s, start, end, parent, first, _, own = nodes[low]
            nodes[low] = [s, start, common, parent, first, 0, first]
            nodes.append([s, common, end, low, first, i, own])
            for node in nodes[low + 1 : -1]:
                if node[3] == low:
                    node[3] = len(nodes) - 1
            stack.append(low)
        if len(p) > common or not stack:
            nodes.append([i, common, len(p), stack[-1] if stack else -1, i, 0, i + 1])
            stack.append(len(nodes) - 1)
        else:
            nodes[stack[-1]][6] = i + 1
    for node in stack:
        nodes[node][5] = len(paths)
    table = np.array(nodes, np.int64)
    lengths = np.array([len(p) for p in paths], np.int64)
    by_size = sizes[order]
    child: list[list[int]] = [[] for _ in nodes]
    roots = []
    for k, node in enumerate(nodes):
        (child[node[3]] if node[3] >= 0 else roots).append(k)
    first, stop = table[:, 4], table[:, 5]
    bounds = np.stack([first, stop], 1).ravel()

    def over(values: np.ndarray, how: np.ufunc) -> np.ndarray:
        return how.reduceat(np.append(values, values[-1]), bounds)[::2]

    return Trie(
        order,
        np.concatenate([paths[s][a:b] for s, a, b, *_ in nodes]) if nodes else np.zeros(0, np.int64),
        np.concatenate([[0], np.cumsum(table[:, 2] - table[:, 1])]),
        first,
        stop,
        table[:, 6],
        [np.array(c, np.int64) for c in child],
        np.array(roots, np.int64),
        over(lengths, np.maximum) - table[:, 2],
        np.array([paths[s][b - 1] if b else -1 for s, _, b, *_ in nodes], np.int64),
        over(by_size, np.minimum),
        over(by_size, np.maximum),
    )


def link_components(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first set of its component; sets link if 100 * shared >= percent * united.

    Where side is given, only sets of different sides are compared. Every pair of sets that isn't connected by
    other links already is either compared or ruled out by a bound, so no component is missed.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return label
    ranks = rank_sets(sets)
    trie = build(ranks, sizes)
    n_tokens = int(trie.tokens.max()) + 1 if len(trie.tokens) else 0
    group = np.arange(n)  # component by tree position
    members = {i: [i] for i in range(n)}
    size = sizes[trie.order]
    sides = None if side is None else side[trie.order]
    has = np.zeros(n_tokens + 1, np.int64)
    for q in range(n):
        path = ranks[trie.order[q]]
        other = group != group[q]
        other[: q + 1] = False
        if sides is not None:
            other &= sides != sides[q]
        if not other.any() or not len(path):
            continue
        rest = np.concatenate([[0], np.cumsum(other)])
        has[path] = 1
        nodes = trie.roots
        upper = np.zeros(len(nodes), np.int64)
        while len(nodes):
            lo, hi = trie.seg[nodes], trie.seg[nodes + 1]
            length = hi - lo
            flat = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            sums = np.concatenate([[0], np.cumsum(has[trie.tokens[flat]])])
            ends = np.cumsum(length)
            shared = upper + sums[ends] - sums[ends - length]
            ahead = len(path) - np.searchsorted(path, trie.last[nodes], side="right")
            most = shared + np.minimum(trie.left[nodes], ahead)
            alive = (
                (rest[trie.stop[nodes]] > rest[trie.first[nodes]])
                & (most * (100 + percent) >= percent * (size[q] + trie.small[nodes]))
                & (100 * trie.large[nodes] >= percent * size[q])
                & (percent * trie.small[nodes] <= 100 * size[q])
            )
            nodes, shared = nodes[alive], shared[alive]
            for k in np.flatnonzero(trie.own[nodes] > trie.first[nodes]).tolist():
                for s in range(int(trie.first[nodes[k]]), int(trie.own[nodes[k]])):
                    if other[s] and group[s] != group[q] and shared[k] * (100 + percent) >= percent * (size[q] + size[s]):
                        keep, gone = sorted((int(group[q]), int(group[s])), key=lambda g: -len(members[g]))
                        moved = members.pop(gone)
                        group[moved] = keep
                        members[keep] += moved
            below = [trie.child[k] for k in nodes.tolist()]
            upper = np.repeat(shared, [len(c) for c in below])
            nodes = np.concatenate(below) if below else np.zeros(0, np.int64)
        has[path] = 0
    by_set = np.empty(n, np.int64)
    by_set[trie.order] = group
    least: dict[int, int] = {}
    for i, g in enumerate(by_set.tolist()):
        least.setdefault(g, i)
    return np.array([least[g] for g in by_set.tolist()])
