"""Bin packing by the configuration linear program over a histogram of lengths.

A configuration is a set of lengths that fits one bin. The program asks how often each configuration is used so that
every piece is covered and the bins are fewest. Multiplicative weights solve it: a length's price falls as its
coverage grows, and a knapsack dynamic program finds the configurations that are worth most at the present prices.
The fractional solution is rounded down, then its largest fractions up where pieces are left; the rest is a program of
its own. At the end, uses that leave room in a bin are undone, and their pieces and the last ones go by best fit. The
input is a histogram (at most one number a length), so nothing here grows with the pieces.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

#: Lengths that compete for one configuration; each round deals all lengths to such groups anew.
GROUP = 48
#: Fraction of a length's pieces that one step may cover, how fast prices fall, and rounds of a program.
STEP, RATE, ROUNDS = 0.2, 0.1, 30
#: Programs in a row, each on what the rounding of the one before has left.
PROGRAMS = 2

Configuration = tuple[tuple[int, int], ...]  # (length, times), longest first


def knapsack(lengths: list[int], most: list[int], prices: list[float], capacity: int) -> Configuration:
    """The configuration of the highest total price: each length at most ``most`` times."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for l, m, p in zip(lengths, most, prices, strict=True):
        k, left = 1, min(m, capacity // l)
        while left > 0:  # times split into 1, 2, 4, ... and the rest
            k = min(k, left)
            size = k * l
            with_it = best[: capacity + 1 - size] + k * p
            better = with_it > best[size:]
            best[size:] = np.where(better, with_it, best[size:])
            taken.append((l, k, better))
            left -= k
            k *= 2
    room, out = int(np.argmax(best)), Counter()
    for l, k, better in reversed(taken):
        if room >= k * l and better[room - k * l]:
            out[l] += k
            room -= k * l
    return tuple(sorted(out.items(), reverse=True))


def most_worth(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """Highest total price of any configuration, lengths as often as they fit: the scale that makes prices a dual solution."""
    dense = np.full(capacity + 1, -np.inf)
    dense[lengths] = prices
    best = np.zeros(capacity + 1)
    for c in range(int(lengths.min()), capacity + 1):
        best[c] = max(best[c - 1], (best[c - 1 :: -1] + dense[1 : c + 1]).max() if c > 1 else dense[1])
    return float(best[capacity])


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[dict[Configuration, float], np.ndarray]:
    """Uses of configurations that cover every length about once over, and the last prices."""
    place = {int(l): i for i, l in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    uses: dict[Configuration, float] = {}
    groups = -(-len(lengths) // GROUP)
    prices = lengths.astype(float)
    for _ in range(ROUNDS):
        prices = lengths * np.exp(-RATE * (covered - covered.min()) / STEP)
        for group in np.array_split(rng.permutation(len(lengths)), groups):
            found = knapsack(lengths[group].tolist(), counts[group].tolist(), prices[group].tolist(), capacity)
            at = [place[l] for l, _ in found]
            times = np.array([k for _, k in found], float)
            step = max(STEP * float((counts[at] / times).min()), 1e-9)
            covered[at] += step * times / counts[at]
            uses[found] = uses.get(found, 0.0) + step
        if covered.min() >= 1:
            break
    return {c: u / max(1.0, max(covered[place[l]] for l, _ in c)) for c, u in uses.items()}, prices


def best_fit(left: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """Longest first, each into the fullest open bin that has room; equal bins take equal pieces together, so counts may be large."""
    rooms = np.zeros(capacity + 1, bool)
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for l in sorted(left, reverse=True):
        n = left[l]
        while n:
            at = l + int(np.argmax(rooms[l:]))
            if not rooms[at]:
                break
            held, many = bins[at].popitem()
            used = min(n, many)
            if used < many:
                bins[at][held] = many - used
            rooms[at] = bool(bins[at])
            after = bins[at - l]
            after[(*held, l)] = after.get((*held, l), 0) + used
            rooms[at - l] = True
            n -= used
        times = capacity // l
        for each, many in ((times, n // times), (n % times, 1)):
            if each and many:
                after = bins[capacity - each * l]
                after[(l,) * each] = after.get((l,) * each, 0) + many
                rooms[capacity - each * l] = True
    out: Counter = Counter()
    for group in bins:
        for held, many in group.items():
            out[tuple(sorted(Counter(held).items(), reverse=True))] += many
    return out


def solve(histogram: dict[int, int], capacity: int, seed: int = 7) -> tuple[list[tuple[Configuration, int]], int]:
    """``(configurations with their uses, lower bound of the number of bins)``; every piece lies in exactly one use.

    The bound is the better one of total length and the dual value of the prices; it holds for every packing.
    """
    if any(not 0 < l <= capacity for l in histogram):
        raise ValueError(f"lengths lie between 1 and {capacity}")
    left = Counter({l: n for l, n in histogram.items() if n})
    out: Counter = Counter()
    bound = -(-sum(l * n for l, n in left.items()) // capacity)
    rng = np.random.default_rng(seed)
    for program in range(PROGRAMS):
        if not left:
            break
        lengths = np.array(sorted(left))
        counts = np.array([left[int(l)] for l in lengths], float)
        uses, prices = fractional(lengths, counts.astype(np.int64), capacity, rng)
        if not program:
            worth = most_worth(lengths, prices, capacity)
            bound = max(bound, math.ceil(float(counts @ prices) / worth - 1e-6))
        parts = []
        for c, u in uses.items():
            if whole := min(int(u), *(left[l] // k for l, k in c)):
                out[c] += whole
                left.subtract({l: k * whole for l, k in c})
            parts.append((u - int(u), c))
        for _, c in sorted(parts, reverse=True):
            if all(left[l] >= k for l, k in c):
                out[c] += 1
                left.subtract(dict(c))
        left = +left
    for c, u in list(out.items()):
        if sum(l * k for l, k in c) < capacity:
            left.update({l: k * u for l, k in c})
            del out[c]
    out.update(best_fit(left, capacity))
    return sorted(out.items(), reverse=True), bound
