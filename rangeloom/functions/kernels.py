"""Numeric kernels on the pivots and histograms of one group. All inputs are bounded: bins, pivots and buffered keys.

A histogram's weight lies evenly within each bin. Values are found in closed form from cumulative weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

SAME_KEY = 1e-7


def dedup_sorted(keys: np.ndarray, eps: float = SAME_KEY) -> np.ndarray:
    """Sorted 32-bit keys without those within ``eps`` of the last one kept."""
    keys = np.asarray(keys, np.float32)
    kept: list[np.float32] = []
    for k in np.unique(keys):
        if not kept or float(k - kept[-1]) > eps:
            kept.append(k)
    return np.array(kept, np.float32)


def split_keys(keys: np.ndarray, lo: float | None, hi: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Buffered keys left and right of a range, sorted, without repeats; those inside count for neither side.

    Where the range is not set all are left. NaN is on neither side.
    """
    keys = np.asarray(keys, np.float32)
    keys = keys[~np.isnan(keys)]
    if lo is None or hi is None:
        return dedup_sorted(keys), np.zeros(0, np.float32)
    return dedup_sorted(keys[keys < lo]), dedup_sorted(keys[keys >= hi])


def positions(left: int, middle: float, right: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` pivots over keys left of bins, the bins' weight and keys right of them: the source (0, 1 or 2, 3 for the end) of each,
    and where in it: the place among the sorted keys, which may lie between two, or the weight in the bins."""
    total = left + middle + right
    at = total * np.arange(n) / (n - 1)
    source = np.where(at < left, 0, np.where(at - left < middle, 1, np.where(at - left - middle < right, 2, 3)))
    place = np.where(source == 0, at * (left - 1) / max(left, 1), np.where(source == 1, at - left, (at - left - middle) * (right - 1) / max(right, 1)))
    return source, place


def histogram_value(edges: np.ndarray, weights: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a histogram at given weights. At a bin's full weight it is the bin's right edge, at 0 the first edge."""
    edges, weights = np.asarray(edges, np.float64), np.asarray(weights, np.float64)
    weight = np.asarray(weight, np.float64)
    upto = np.cumsum(weights)
    # weights that miss a bin's end by rounding belong to it
    at = np.minimum(np.searchsorted(upto, weight - 1e-12 * max(1.0, upto[-1]), side="left"), len(weights) - 1)
    share = np.divide(weight - (upto[at] - weights[at]), weights[at], out=np.zeros(len(weight)), where=weights[at] > 0)
    value = edges[at] + np.clip(share, 0, 1) * (edges[at + 1] - edges[at])
    return np.where(weight <= 0, edges[0], np.where(weight >= upto[-1], edges[-1], value))


def combined_pivots(keys: np.ndarray, edges: Sequence[float] | None, weights: Sequence[float] | None, n: int) -> tuple[np.ndarray, float]:
    """``n`` pivots of equal weight over buffered keys and bins, and the weight between two of them.

    The keys left of the bins come first, then the bins, then the keys right of them. Where the weight of one is used up
    the value is the start of the next that has any. Nothing at all gives zeros and weight 0.
    """
    has_bins = edges is not None and len(edges) > 1
    left, right = split_keys(keys, edges[0] if has_bins else None, edges[-1] if has_bins else None)
    middle = float(np.sum(weights)) if has_bins else 0.0
    value = lambda keys, place: np.interp(place, np.arange(len(keys)), keys.astype(np.float64)) if len(keys) else place
    ends = [(float(side[0]), float(side[-1])) if len(side) else None for side in (left, right)]
    return pivots_at(len(left), len(right), ends, lambda place: value(left, place), lambda place: value(right, place), edges if has_bins else None, weights, n)


def pivots_at(n_left: int, n_right: int, ends: Sequence[tuple[float, float] | None], left: Callable, right: Callable, edges: Sequence[float] | None, weights: Sequence[float] | None, n: int) -> tuple[np.ndarray, float]:
    """As ``combined_pivots``, from the numbers of keys on both sides, their first and last ones, and functions that give
    the values at places among them."""
    middle = float(np.sum(weights)) if edges is not None else 0.0
    total = n_left + middle + n_right
    if total == 0:
        return np.zeros(n), 0.0
    source, place = positions(n_left, middle, n_right, n)
    above = [float(np.nextafter(np.float32(e[1]), np.float32(np.inf))) if e else None for e in ends]
    first = ends[0][0] if ends[0] else float(edges[0]) if edges is not None else ends[1][0]
    last = above[1] if above[1] is not None else float(edges[-1]) if edges is not None else above[0]
    out = np.full(n, last)
    for i, of in enumerate((left, lambda place: histogram_value(np.asarray(edges), np.asarray(weights), place), right)):
        if (hit := source == i).any():
            out[hit] = of(place[hit])
    out[0], out[-1] = first, last
    return np.maximum.accumulate(out), total / (n - 1)


def union_histogram(sets: Sequence[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """One histogram from several pivot sets with their weight between two pivots: edges and weights.

    Each chunk's weight is spread evenly over its width. Chunks without width drop out, gaps get weight 0.
    """
    sets = [(np.asarray(p, np.float64), w) for p, w in sets if len(p) > 1]
    if not sets:
        return np.zeros(0), np.zeros(0)
    edges = np.unique(np.concatenate([p for p, _ in sets]))
    upto = np.zeros(len(edges))
    for pivots, weight in sets:
        points = np.unique(pivots)
        if len(points) > 1:
            upto += weight * np.interp(edges, points, np.arange(len(points)))
    return edges, np.diff(upto)


def resample(sets: Sequence[tuple[np.ndarray, float]], n: int) -> tuple[np.ndarray, float]:
    """``n`` pivots of equal weight over the union of pivot sets, and the weight between two; zeros where there is nothing."""
    edges, weights = union_histogram([s for s in sets if s[1] > 0])
    total = float(weights.sum()) if len(weights) else 0.0
    if total <= 0:
        return np.zeros(n), 0.0
    return histogram_value(edges, weights, total * np.arange(n) / (n - 1)), total / (n - 1)


def tree_fanout(world: int) -> tuple[int, int, int]:
    """The fan-out of the three stages of a reduction tree over ``world`` ranks, a multiple of 4.

    The first is the smallest divisor from the cube root on, the second of what remains from the square root on.
    """
    if world < 4 or world % 4:
        raise ValueError("the number of ranks must be a multiple of 4")

    def divisor(n: int, start: int) -> int:
        return next((f for f in range(max(start, 1), n) if n % f == 0), 1)

    first = divisor(world, int(world ** (1 / 3)))
    second = divisor(world // first, int((world // first) ** 0.5))
    return first, second, world // (first * second)


def tree_resample(sets: Sequence[tuple[np.ndarray, float]], counts: Sequence[int], ranks: int) -> list[list[tuple[np.ndarray, float]]]:
    """The three stages of merging the pivot sets of all ranks: ``counts`` pivots after stages 1 and 2, ranks + 1 at the root."""
    f1, f2, _ = tree_fanout(len(sets))
    stages, current = [], list(sets)
    for fan, n in ((f1, counts[0]), (f2, counts[1]), (None, ranks + 1)):
        fan = fan or len(current)
        current = [resample(current[i : i + fan], n) for i in range(0, len(current), fan)]
        stages.append(current)
    return stages


def apportion(weights: Sequence[float], n: int) -> list[int]:
    """n items over weights: each takes its rounded share of what remains, so that all are given away."""
    left, out = float(sum(weights)), []
    for w in weights:
        # half away from zero, on 32-bit shares
        take = int(np.floor(np.float32(w / left * n) + np.float32(0.5))) if left > 0 else 0
        out.append(take)
        left, n = left - w, n - take
    return out
