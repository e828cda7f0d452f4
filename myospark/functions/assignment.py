"""Least-cost links between two sets of places."""

from __future__ import annotations

import numpy as np


def near_pairs(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the pairs no further apart than reach, found by grid cells."""
    if not len(a) or not len(b):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    cells = np.floor(a / reach).astype(np.int64)
    key = cells[:, 0] * (1 << 32) + cells[:, 1]
    order = np.argsort(key, kind="stable")
    ordered, own = key[order], np.floor(b / reach).astype(np.int64)
    found = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            want = (own[:, 0] + dx) * (1 << 32) + own[:, 1] + dy
            low, high = np.searchsorted(ordered, want, "left"), np.searchsorted(ordered, want, "right")
            n = high - low
            j = np.repeat(np.arange(len(b)), n)
            found.append((order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], j))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    d2 = ((a[i] - b[j]) ** 2).sum(1)
    near = d2 <= reach * reach
    return i[near], j[near], d2[near]


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost assignment of all rows; no more rows than columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, base, last = i, 0.0, -1
        while True:
            step = base + cost[r] - u[r] - v
            better = ~done & (step < least)
            least[better], came[better] = step[better], last
            j = int(np.argmin(np.where(done, np.inf, least)))
            base, last = least[j], j
            if row_of[j] < 0:
                break
            done[j] = True
            r = row_of[j]
        used = np.flatnonzero(done)
        u[row_of[used]] += base - least[used]
        v[used] -= base - least[used]
        u[i] += base
        while True:
            before = came[last]
            row_of[last] = i if before < 0 else row_of[before]
            if before < 0:
                break
            last = before
    out = np.empty(n, np.int64)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def cheapest_links(tracks: np.ndarray, places: np.ndarray, reach: float) -> np.ndarray:
    """The track of each place, -1 for none: the links within reach whose squared lengths, and reach squared for every
    track that a linked place could have had but that goes without, add up to the least. Candidates that touch form
    small subnets, each solved on its own."""
    out = np.full(len(places), -1, np.int64)
    i, j, d2 = near_pairs(tracks, places, reach)
    if not len(i):
        return out
    times_i, times_j = np.bincount(i, minlength=len(tracks)), np.bincount(j, minlength=len(places))
    sole = (times_i[i] == 1) & (times_j[j] == 1)
    out[j[sole]] = i[sole]
    i, j, d2 = i[~sole], j[~sole], d2[~sole]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        parent[root(a)] = root(-1 - b)
    nets: dict[int, list[int]] = {}
    for k, a in enumerate(i.tolist()):
        nets.setdefault(root(a), []).append(k)
    for net in nets.values():
        rows, at_row = np.unique(i[net], return_inverse=True)
        cols, at_col = np.unique(j[net], return_inverse=True)
        cost = np.full((len(rows), len(cols) + len(rows)), 1e12)
        cost[at_row, at_col] = d2[net]
        cost[:, len(cols) :] = reach * reach  # a column of its own for every track that goes without
        chosen = assign(cost)
        linked = chosen < len(cols)
        out[cols[chosen[linked]]] = rows[linked]
    return out
