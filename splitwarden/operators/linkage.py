"""Greedy first-fit linkage of one component of items.

Items and clusters stand in the order of their (first) rows. Of all pairs of clusters whose linkage reaches a threshold
the first one, by the earlier and then by the later cluster, is merged, until there is none.

* complete linkage: merging only takes candidates away. In the order of rows, each cluster takes the first row that all
  its members reach, until none is left; clusters before it are finished. Each member meets only what is left.
* average linkage: rows are opened in their order. All clusters opened before have nothing to merge with, so that only
  the one that changed last is looked at: first against the clusters opened, then against the rows not opened yet, whose
  sums of similarities to it are carried on by one row of similarities a merge. Between clusters the sum follows
  from one vector each (the sum of its members' vectors, or how many of its hashes have each bit).

``first_fit`` and ``averaged`` hold the items and a few numbers for each; time is at most n * n similarities. ``complete``
and ``average`` take a graph of one bit a pair instead (n * n / 8 bytes, and as much again).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

BLOCK = 512
#: Rows whose vectors are made at a time.
WIDE = 8192


def graph(n: int, reach: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Bits of each row's neighbours; reach gives for some rows which others they reach."""
    out = np.zeros((n, (n + 7) // 8), np.uint8)
    for a in range(0, n, BLOCK):
        rows = np.arange(a, min(n, a + BLOCK))
        near = reach(rows).copy()
        near[np.arange(len(rows)), rows] = False
        out[rows] = np.packbits(near, axis=1, bitorder="little")
    return out


def _members(bits: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits, count=n, bitorder="little"))


def complete(near: np.ndarray) -> np.ndarray:
    """For each row the first row of its cluster."""
    n = len(near)
    of, free = np.arange(n), np.packbits(np.ones(n, bool), bitorder="little")
    for a in range(n):
        if of[a] != a:
            continue
        free[a >> 3] &= ~np.uint8(1 << (a & 7))
        shared = near[a] & free
        while True:
            some = np.flatnonzero(shared)
            if not len(some):
                break
            byte = int(shared[some[0]])
            b = int(some[0]) * 8 + (byte & -byte).bit_length() - 1
            of[b] = a
            free[b >> 3] &= ~np.uint8(1 << (b & 7))
            shared &= near[b] & free
    return of


def first_fit(data: np.ndarray, reach: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first row of its cluster by complete linkage. reach(item, items): which items it reaches."""
    n = len(data)
    of, rest, open_ = np.arange(n), np.arange(n), np.ones(n, bool)
    at, left = 0, n
    while left:
        at += int(np.argmax(open_[at:]))
        a, own, open_[at] = int(rest[at]), data[at], False
        shared, taken = np.flatnonzero(reach(own, data[at:]) & open_[at:]) + at, []
        while len(shared):
            taken.append(shared[0])
            shared = shared[1:]
            shared = shared[reach(data[taken[-1]], data[shared])]
        of[rest[taken]], open_[taken] = a, False
        left -= 1 + len(taken)
        if 2 * left < len(rest):
            rest, data, open_, at = rest[open_], data[open_], open_[open_], 0
    return of


def averaged(data: np.ndarray, least: float, one: Callable[[np.ndarray, np.ndarray], np.ndarray], sums: Callable[[np.ndarray], np.ndarray], between: Callable[[np.ndarray, float, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first row of its cluster by average linkage. one(item, items): similarities; sums(items): one
    vector each; between as in average."""
    n = len(data)
    of, rest, open_ = np.arange(n), np.arange(n), np.ones(n, bool)
    # Clusters in their order: first row, size (0 once merged into another) and sum.
    k, first, size, total = 0, np.zeros(16, np.int64), np.zeros(16), np.zeros((16, sums(data[:1]).shape[1]))

    def to_rest(c: int) -> np.ndarray:
        """Sums of similarities of a cluster to the rows not opened."""
        ones = np.ones(WIDE)
        return np.concatenate([between(total[c], size[c], sums(data[s : s + WIDE]), ones[: len(data) - s]) for s in range(0, len(data), WIDE)] or [np.zeros(0)])

    at = 0
    while True:
        at += int(np.argmax(open_[at:])) if at < len(rest) else 0
        if at == len(rest) or not open_[at]:
            break
        if k == len(first):
            held = size[:k] > 0
            k = int(held.sum())
            first, size, total = (np.concatenate([x[held], np.zeros((k, *x.shape[1:]), x.dtype)]) for x in (first[: len(held)], size[: len(held)], total[: len(held)]))
        now, k = k, k + 1
        first[now], size[now], total[now], open_[at] = rest[at], 1, sums(data[at : at + 1])[0], False
        near, changed = one(data[at], data), False
        while True:
            if changed:
                reached = (between(total[now], size[now], total[:k], size[:k]) >= least * size[now] * size[:k]) & (size[:k] > 0)
                reached[now] = False
                other = int(np.argmax(reached))
                if reached[other]:
                    near = near + to_rest(other)
                    now, gone = min(now, other), max(now, other)
                    of[first[gone]] = first[now]
                    total[now] += total[gone]
                    size[now] += size[gone]
                    size[gone] = 0
                    continue
            reached = (near >= least * size[now]) & open_
            b = int(np.argmax(reached)) if len(reached) else 0
            if not len(reached) or not reached[b]:
                break
            of[rest[b]] = first[now]
            total[now] += sums(data[b : b + 1])[0]
            size[now] += 1
            open_[b], changed = False, True
            near = near + one(data[b], data)
            if 2 * np.count_nonzero(open_) < len(rest):
                rest, data, near, open_, at = rest[open_], data[open_], near[open_], open_[open_], 0
    while (of[of] != of).any():
        of = of[of]
    return of


def average(near: np.ndarray, sums: np.ndarray, least: float, between: Callable[[np.ndarray, float, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first row of its cluster. sums: one vector a row; between(sum, size, sums, sizes): the sums of
    similarities between one cluster and others."""
    n = len(near)
    near, reach = near.copy(), near.copy()
    of, size, sums = np.arange(n), np.ones(n), sums.copy()
    # Rows that may have a later cluster to merge with.
    first = [a for a in range(n) if near[a].any()]
    while first:
        a = first[0]
        later = _members(reach[a], n) if of[a] == a else np.zeros(0, int)
        later = later[later > a]
        if not len(later):
            heapq.heappop(first)
            continue
        b = int(later[0])
        of[of == b] = a
        sums[a] += sums[b]
        size[a] += size[b]
        near[a] |= near[b]
        gone, mine = ~np.uint8(1 << (b & 7)), np.uint8(1 << (a & 7))
        for bits in (near, reach):
            bits[b] = 0
            bits[:, b >> 3] &= gone
        near[a, a >> 3] &= ~mine
        others = _members(near[a], n)
        near[others, a >> 3] |= mine
        value = between(sums[a], size[a], sums[others], size[others])
        now = others[value >= least * size[a] * size[others]]
        reach[a] = 0
        reach[:, a >> 3] &= ~mine
        reach[a] = np.packbits(np.isin(np.arange(n), now, assume_unique=True), bitorder="little")
        reach[now, a >> 3] |= mine
        for c in now[now < a].tolist():
            heapq.heappush(first, c)
    return of


def cosine_graph(vectors: np.ndarray, least: float) -> np.ndarray:
    return graph(len(vectors), lambda rows: vectors[rows] @ vectors.T >= least)


def hash_graph(hashes: np.ndarray, most: float) -> np.ndarray:
    return graph(len(hashes), lambda rows: np.bitwise_count(hashes[rows][:, None] ^ hashes) <= most)


def by_vectors(total: np.ndarray, size: float, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of cosines, from sums of vectors of length 1."""
    return sums @ total


def by_bits(total: np.ndarray, size: float, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of distances, negative, from how many hashes have each bit."""
    return -(sums @ (size - 2 * total) + sizes * total.sum())


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
