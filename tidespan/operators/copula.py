"""Serial independence at all lags at once: the distance of the empirical copula of (x_t, ..., x_{t+lag}) from the product of its margins
(Genest and Remillard 2004), its null law from shuffles of the ranks.

Vectors lie inside segments, so no pair of gaps straddles a break in reading; a cell of one segment has the statistic of the published test. A cell is one task.
Draws go in blocks of bounded size; a draw costs the square of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidespan.operators.permutation import _mid_ranks
from tidespan.operators.renewal import cells_at_once, draw_factors, shuffled

#: Numbers in a block of vectors.
BLOCK = 120_000
#: Distances this near count as equal: those of few vectors are fractions that tie often, and rounding would cut between them.
TIED = 3.7e-11


def distances(u: np.ndarray) -> np.ndarray:
    """u: draws by vectors by coordinates, ranks over their number -> n times the integral of (C_n - product of margins)^2 of each draw, in closed form.
    Each pair of vectors is met once, all pairs as far apart together; arrays hold no more numbers than u. Sums and products are in the SQL's order where two vectors leave no other."""
    v = np.ascontiguousarray(1 - u.T)  # coordinates by vectors by draws
    n = v.shape[1]
    means, whole = v.copy(), v.prod(axis=0)
    for far in range(1, n):
        least = np.minimum(v[:, far:], v[:, :-far])
        means[:, far:] += least
        means[:, :-far] += least
        both = least.prod(axis=0)
        whole[far:] += both
        whole[:-far] += both
    means /= n
    return whole.sum(axis=0) / n - 2 * means.prod(axis=0).sum(axis=0) + means.mean(axis=1).prod(axis=0, initial=n)


def cvm_distance(u: np.ndarray) -> float:
    """The distance of one set of vectors (n by coordinates)."""
    return float(distances(np.asarray(u, float)[None])[0])


def _blocks(x: np.ndarray, segment: np.ndarray, h: np.ndarray, factors: tuple[np.ndarray, np.ndarray], lag: int) -> Iterator[np.ndarray]:
    """Vectors of ranks, draws in blocks; draw 0 is the order as observed."""
    runs = [r for r in np.split(np.arange(len(x)), np.flatnonzero(np.diff(segment)) + 1) if len(r) > lag]
    rank = _mid_ranks(x) / len(x)
    n = sum(len(r) - lag for r in runs)
    step = max(1, BLOCK // (n * (lag + 1)))
    for low in range(0, len(factors[0]), step):
        k, c = (f[low : low + step] for f in factors)
        out, at = np.empty((lag + 1, n, len(k))), 0
        for r in runs:
            order = shuffled(h[r], k, c)
            if low == 0:
                order[0] = np.arange(len(r))
            drawn, here = rank[r][order.T], len(r) - lag
            for j in range(lag + 1):
                out[j, at : at + here] = drawn[j : j + here]
            at += here
        yield out.T


def serial_independence(gaps: DataFrame, lag: int = 5, n_null: int = 1000, seed: int = 7) -> DataFrame:
    """gaps: cell, segment, i, x, tau -> cell, n, n_vectors, n_segments, lag, statistic, p, reason. p = (shuffles as far + 1/2) / (shuffles + 1), as published; a cell with
    fewer than two vectors, or whose gaps are all equal, has a reason. Shuffles stay inside segments and are those of ``renewal.draws``."""
    factors = draw_factors(n_null, seed)

    def cell(segment: np.ndarray, x: np.ndarray, _: np.ndarray, h: np.ndarray) -> list:
        _, lengths = np.unique(segment, return_counts=True)
        vectors = int(np.maximum(lengths - lag, 0).sum())
        why = "fewer than two vectors" if vectors < 2 else "all gaps are equal" if np.ptp(x) == 0 else ""
        value, p = None, None
        if not why:
            s = np.concatenate([distances(u) for u in _blocks(x, segment, h, factors, lag)])
            value, p = float(s[0]), (int((s[1:] > s[0] - TIED).sum()) + 0.5) / (n_null + 1)
        return [[len(x)], [vectors], [len(lengths)], [lag], [value], [p], [why]]

    def run(starts: np.ndarray, *arrays: np.ndarray) -> Iterator[list]:
        for a, b in zip(starts, [*starts[1:], len(arrays[0])], strict=True):
            yield cell(*(v[a:b] for v in arrays))

    return cells_at_once(gaps, seed, run, "n long, n_vectors long, n_segments long, lag long, statistic double, p double, reason string")
