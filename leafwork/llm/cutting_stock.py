"""Cutting-stock patterns over a length histogram, by column generation."""

from __future__ import annotations

import numpy as np


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of items of size 1..len(values) of most value in capacity."""
    n = len(values)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(n, c)
        offers = best[c - k : c][::-1] + values[:k]
        j = int(np.argmax(offers))
        if offers[j] > best[c - 1] + 1e-12:
            best[c], choice[c] = offers[j], j + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def fullest(left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts, none above those left, of the largest size there is and of what fills the rest of capacity most; larger sizes come first."""
    counts = np.zeros_like(left)
    top = int(np.flatnonzero(left)[-1]) + 1
    counts[top - 1] = 1
    room = capacity - top
    reached, last = np.zeros(room + 1, bool), np.zeros(room + 1, np.int64)
    reached[0] = True
    for s in np.flatnonzero(left[:room])[::-1].tolist():
        size = s + 1
        for _ in range(min(int(left[s]) - (size == top), room // size)):
            new = np.zeros_like(reached)
            new[size:] = reached[:-size]
            new &= ~reached
            if not new.any():
                break
            last[new] = size
            reached |= new
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        counts[last[at] - 1] += 1
        at -= last[at]
    return counts


def solve(demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(times, counts by size - 1) of patterns that meet the demand, and no more.

    demand[i] pieces have size i + 1. The linear program "least number of
    sequences" over all patterns is solved by the revised simplex method: the
    dual prices value the sizes, a knapsack finds the pattern of most value,
    and it enters the basis while its value passes 1. The solution is rounded
    down; what that leaves is packed by patterns that fullest makes, each as often as it can be, until
    all of the demand is met. The cost depends on the number of sizes and not on the number of pieces.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    need = demand[sizes - 1].astype(float)
    patterns = [np.where(np.arange(m) == i, capacity // s, 0) for i, s in enumerate(sizes)]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes]))
    x = inverse @ need
    for _ in range(rounds):
        prices = inverse.sum(0)  # each pattern costs 1
        values = np.zeros(capacity)
        values[sizes - 1] = np.maximum(prices, 0)
        value, counts = best_pattern(values, capacity)
        if value <= 1 + 1e-9:
            break
        column = counts[sizes - 1]
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        patterns[r] = column
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    left, out = demand.astype(np.int64).copy(), []
    for times, p in sorted(zip(x.tolist(), patterns, strict=True), key=lambda t: -t[0]):
        counts = np.zeros(len(demand), np.int64)
        counts[sizes - 1] = p
        used = counts > 0
        n = int(min(np.floor(times + 1e-9), (left[used] // counts[used]).min())) if used.any() else 0
        if n > 0:
            out.append((n, counts))
            left -= n * counts
    while left.any():
        counts = fullest(left, capacity)
        used = counts > 0
        n = int((left[used] // counts[used]).min())
        out.append((n, counts))
        left -= n * counts
    return out
