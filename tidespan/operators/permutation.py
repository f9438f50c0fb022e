"""Permutation tests of paired series, a group's arrays at a time.

A test orders the second series anew and counts how often the statistic is at least as large as observed (upper tail). Where all n!
orders are no more than the draws, every order is taken and p is the exact share; otherwise p = (1 + hits) / (1 + draws), the draws
seeded by the group's key and the seed. Groups with fewer than three pairs or an undefined statistic have a reason in place of a number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import deal
from tidespan.operators.shape import distance_correlations

#: Numbers that a block of permuted series holds at most.
BLOCK = 2_000_000


def _mid_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(times) - (times - 1) / 2)[inverse]


def xi_of(x: np.ndarray, y: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """xi of x with y in each order, with the tie correction; y is ranked once. Not a number where y is constant."""
    n, s = len(y), np.sort(y)
    r, at_least = np.searchsorted(s, y, "right"), n - np.searchsorted(s, y, "left")
    d = float((at_least * (n - at_least)).sum())
    step = np.abs(np.diff(r[orders[:, np.argsort(x, kind="stable")]], axis=1)).sum(axis=1)
    return 1 - n * step / (2 * d) if d > 0 else np.full(len(orders), np.nan)


def rho_of(x: np.ndarray, y: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Spearman's rho of x with y in each order."""
    a, b = _mid_ranks(x), _mid_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    size = math.sqrt(float(a @ a) * float(b @ b))
    return b[orders] @ a / size if size > 0 else np.full(len(orders), np.nan)


STATISTICS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {"xi": xi_of, "rho": rho_of, "dcor": distance_correlations}


def orders(n: int, draws: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Blocks of orders of n: all n! of them where those are no more than the draws, else as many random ones."""
    rows = max(1, BLOCK // n)
    if n <= 12 and math.factorial(n) <= draws:
        yield np.array(list(permutations(range(n))))
        return
    for low in range(0, draws, rows):
        yield rng.permuted(np.tile(np.arange(n), (min(rows, draws - low), 1)), axis=1)


def upper_p(x: np.ndarray, y: np.ndarray, statistic: str, draws: int, rng: np.random.Generator) -> tuple[float, float, str]:
    """(statistic, p, method) of one group."""
    of = STATISTICS[statistic]
    seen = float(of(x, y, np.arange(len(x))[None, :])[0])
    if not math.isfinite(seen):
        return math.nan, math.nan, "constant"
    exact = len(x) <= 12 and math.factorial(len(x)) <= draws
    hits = sum(int((of(x, y, block) >= seen - 1e-12).sum()) for block in orders(len(x), draws, rng))
    return (seen, hits / math.factorial(len(x)), "exact") if exact else (seen, (1 + hits) / (1 + draws), "permutation")


def paired_permutation(pairs: DataFrame, key: Sequence[str], statistics: Sequence[str] = ("xi",), draws: int = 999, seed: int = 7) -> DataFrame:
    """pairs: key, seq, x, y -> key, n, statistic, value, p and method (exact, permutation, or why there is no number)."""
    key = list(key)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("seq", "ascending")])
        x, y, n = group.column("x").to_numpy(), group.column("y").to_numpy(), group.num_rows
        name = "|".join(str(group.column(k)[0].as_py()) for k in key)
        out = []
        for s in statistics:
            rng = np.random.default_rng([seed, zlib.crc32(f"{name}|{s}".encode())])
            out.append(upper_p(x, y, s, draws, rng) if n >= 3 else (math.nan, math.nan, "fewer than 3 pairs"))
        number = lambda i: pa.array([None if math.isnan(o[i]) else o[i] for o in out], pa.float64())
        same = {k: pa.array([group.column(k)[0].as_py()] * len(out), group.schema.field(k).type) for k in key}
        return pa.table({**same, "n": pa.array([n] * len(out), pa.int64()), "statistic": list(statistics), "value": number(0), "p": number(1), "method": [o[2] for o in out]})

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key) + ", n long, statistic string, value double, p double, method string"
    return deal.by_key(pairs.select(*key, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), *key).groupBy(*key).applyInArrow(run, schema)


def xi_p_value(pairs: DataFrame, key: Sequence[str], draws: int = 999, seed: int = 7, tied: float = 0.0) -> DataFrame:
    """key, n, xi, p and method: the limiting law N(0, 2/5) of sqrt(n) xi where the share of tied y is at most ``tied``, else a permutation test."""
    key = list(key)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("seq", "ascending")])
        x, y, n = group.column("x").to_numpy(), group.column("y").to_numpy(), group.num_rows
        _, inverse, times = np.unique(y, return_inverse=True, return_counts=True)
        value, p, method = math.nan, math.nan, "fewer than 3 pairs"
        if n >= 3 and (times[inverse] > 1).mean() <= tied:
            value, method = float(xi_of(x, y, np.arange(n)[None, :])[0]), "normal"
            p = 0.5 * math.erfc(value * math.sqrt(n) / math.sqrt(0.8))
        elif n >= 3:
            value, p, method = upper_p(x, y, "xi", draws, np.random.default_rng([seed, zlib.crc32("|".join(str(group.column(k)[0].as_py()) for k in key).encode())]))
        number = lambda v: pa.array([None if math.isnan(v) else v], pa.float64())
        return pa.table({**{k: group.column(k).slice(0, 1) for k in key}, "n": pa.array([n], pa.int64()), "xi": number(value), "p": number(p), "method": [method]})

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key) + ", n long, xi double, p double, method string"
    return deal.by_key(pairs.select(*key, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), *key).groupBy(*key).applyInArrow(run, schema)
