"""Ranked slopes of all pairs of a series, in bounded memory however long the series is."""

from __future__ import annotations

import numpy as np

#: Pairs whose slopes are in memory at once; a series of no more is ranked directly.
DIRECT_PAIRS = 2_000_000
#: Pairs drawn to bracket a rank, and how many standard errors a bracket is wide.
DRAWN, WIDTH = 4_000_000, 4.0
Z95 = 1.959963984540054


def _blocks(x: np.ndarray, y: np.ndarray, pairs: int):
    """The slopes from earlier to later dates, a block of pairs at a time."""
    n = len(x)
    step = max(1, pairs // n)
    for first in range(0, n - 1, step):
        last = min(first + step, n - 1)
        dx, dy = x[None, first + 1 :] - x[first:last, None], y[None, first + 1 :] - y[first:last, None]
        later = dx > 0
        yield dy[later] / dx[later]


def _pairs(x: np.ndarray) -> int:
    """Pairs of different dates."""
    equal = np.unique(x, return_counts=True)[1].astype(np.int64)
    return len(x) * (len(x) - 1) // 2 - int((equal * (equal - 1) // 2).sum())


def slopes_at(x: np.ndarray, y: np.ndarray, ranks: list[int], pairs: int = DIRECT_PAIRS, drawn: int = DRAWN) -> list[float]:
    """The slopes at ``ranks`` (from 0) of all sorted slopes; dates ``x`` ascend.

    A long series is not sorted: drawn pairs bracket each rank, one pass counts
    what lies below each bracket and keeps what lies inside.  Slopes equal to a
    bracket's end are only counted, so ties take no room.  A bracket that
    proves too narrow is widened and the pass repeated.
    """
    n = len(x)
    if n * (n - 1) // 2 <= pairs:
        return np.sort(np.concatenate([*_blocks(x, y, pairs), np.zeros(0)]))[ranks].tolist()
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, drawn), rng.integers(0, n, drawn)
    i, j = np.minimum(i, j), np.maximum(i, j)
    held = x[j] > x[i]
    sample = np.sort((y[j[held]] - y[i[held]]) / (x[j[held]] - x[i[held]]))
    total = _pairs(x)
    found: dict[int, float] = {}
    width = WIDTH
    while left := sorted(set(ranks) - set(found)):
        reach = int(width * np.sqrt(len(sample))) + 1
        ends = []
        for r in left:
            at = int(r / total * len(sample))
            ends.append((sample[at - reach] if at >= reach else -np.inf, sample[at + reach] if at + reach < len(sample) else np.inf))
        below, low, high, inside = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), [[] for _ in left]
        for s in _blocks(x, y, pairs):
            for k, (a, b) in enumerate(ends):
                below[k] += np.count_nonzero(s < a)
                low[k] += np.count_nonzero(s == a)
                high[k] += np.count_nonzero(s == b) if b > a else 0
                inside[k].append(s[(s > a) & (s < b)])
        for k, r in enumerate(left):
            own, at = np.concatenate(inside[k]), r - below[k]
            if 0 <= at < low[k]:
                found[r] = float(ends[k][0])
            elif low[k] <= at < low[k] + len(own):
                found[r] = float(np.partition(own, at - low[k])[at - low[k]])
            elif low[k] + len(own) <= at < low[k] + len(own) + high[k]:
                found[r] = float(ends[k][1])
        width *= 4
    return [found[r] for r in ranks]


def _ties(values: np.ndarray) -> float:
    k = np.unique(values, return_counts=True)[1].astype(float)
    return float((k * (k - 1) * (2 * k + 5)).sum())


def median_slope(x: np.ndarray, y: np.ndarray, pairs: int = DIRECT_PAIRS) -> tuple[float, float, float] | None:
    """(median, lower, upper) slope with the 95 % rank interval of Kendall's variance; none under 3 dates or 2 different ones."""
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None
    m = _pairs(x)
    sigma = np.sqrt((n * (n - 1.0) * (2 * n + 5) - _ties(x) - _ties(y)) / 18)
    low, high = max(int(np.round((m - Z95 * sigma) / 2)) - 1, 0), min(int(np.round((m + Z95 * sigma) / 2)), m - 1)
    a, b, lo, hi = slopes_at(x, y, [(m - 1) // 2, m // 2, low, high], pairs)
    return (a + b) / 2, lo, hi
