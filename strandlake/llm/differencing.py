"""Karmarkar-Karp multiway differencing of bounded inputs."""

from __future__ import annotations

import heapq

import numpy as np


def difference(sizes: np.ndarray, ways: int, anchor: np.ndarray | None = None) -> np.ndarray:
    """The part (0 to ways - 1) of each size. ``anchor``: sums that the parts have already; it fixes their order.

    A partial partition is a vector of one sum for each part, less its least. The two of largest spread are added in
    opposite order until one is left. A vector that still has empty parts has its largest sum as spread and stays first
    in line while single sizes fill those parts, largest first; so they are filled at one go.
    """
    n = len(sizes)
    if n == 0 or ways == 1:
        return np.zeros(n, dtype=np.int64)
    order = np.argsort(-np.asarray(sizes, dtype=float), kind="stable")
    singles = np.asarray(sizes, dtype=float)[order]
    at = 0
    # a vector: sums, and for each slot the list of what lies there (indices of sizes; -1 - slot for the anchor's)
    vectors: list[tuple[np.ndarray, list[list]]] = []
    heap: list[tuple[float, int]] = []

    def push(sums: np.ndarray, held: list[list]) -> None:
        sums = sums - sums.min()
        vectors.append((sums, held))
        heapq.heappush(heap, (-float(sums.max()), len(vectors) - 1))

    if anchor is not None and np.ptp(anchor) > 0:
        push(np.asarray(anchor, dtype=float), [[-1 - k] for k in range(ways)])
        anchored = True
    else:
        anchored = False
    while at < n or len(heap) > 1:
        spread = -heap[0][0] if heap else -1.0
        if at < n and singles[at] >= spread:  # a single size leads: it starts a vector of its own
            top = np.zeros(ways)
            top[0] = singles[at]
            held: list[list] = [[] for _ in range(ways)]
            held[0] = [int(order[at])]
            at += 1
        else:
            k = heapq.heappop(heap)[1]
            top, held = vectors[k]
            vectors[k] = None  # type: ignore[call-overload]
        rival = -heap[0][0] if heap else -1.0
        if at < n and singles[at] >= rival:
            empty = np.flatnonzero(top == 0)
            limit = n - at if rival < 0 else int(np.searchsorted(-singles[at:], -rival, side="right"))
            take = max(1, min(len(empty), limit))
            top = top.copy()
            for j in range(take):
                slot = int(empty[j])
                top[slot] += singles[at]
                held[slot] = [*held[slot], int(order[at])] if held[slot] else [int(order[at])]
                at += 1
            push(top, held)
        elif heap:
            k = heapq.heappop(heap)[1]
            other, theirs = vectors[k]
            vectors[k] = None  # type: ignore[call-overload]
            down, up = np.argsort(-top, kind="stable"), np.argsort(other, kind="stable")
            sums, joined = np.empty(ways), []
            for j, (a, b) in enumerate(zip(down.tolist(), up.tolist(), strict=True)):
                sums[j] = top[a] + other[b]
                joined.append(held[a] + theirs[b] if len(held[a]) >= len(theirs[b]) else theirs[b] + held[a])
            push(sums, joined)
        else:
            push(top, held)
    parts = np.zeros(n, dtype=np.int64)
    _, held = vectors[heap[0][1]]
    for slot, own in enumerate(held):
        shard = next((-1 - k for k in own if k < 0), slot) if anchored else slot
        for k in own:
            if k >= 0:
                parts[k] = shard
    return parts
