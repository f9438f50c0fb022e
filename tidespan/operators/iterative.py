"""Estimators that iterate: one group's arrays at a time in NumPy, groups in parallel.

A group is one cell (record, threshold, side) or one comparison; groups that could grow without bound do not come here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.functions.special import bisect, chi2_quantile, t_quantile
from tidespan.operators import deal


def innermost(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Innermost intervals of half-open observations (lo, hi]: a left end directly followed by a right end. A right end at some value comes before an open left end there, and after the closed left end of an exact observation (lo = hi)."""
    value = np.concatenate([hi, lo])
    kind = np.concatenate([np.ones(len(hi), np.int8), np.where(lo == hi, 0, 2).astype(np.int8)])
    by = np.lexsort((kind, value))
    value, right = value[by], kind[by] == 1
    at = np.flatnonzero(~right[:-1] & right[1:])
    return value[at], value[at + 1]


class Ranges:
    """Sums over ranges of a vector and the adjoint, by doubling: only positive numbers are added, so small sums keep their digits. n + m numbers a level, log m levels."""

    def __init__(self, first: np.ndarray, last: np.ndarray, size: int):
        self.size, self.n, self.levels, at = size, len(first), [], first.copy()
        length = last - first
        for k in range(int(length.max(initial=0)).bit_length()):
            some = np.flatnonzero(length >> k & 1)
            self.levels.append((some, at[some]))
            at[some] += 1 << k

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each range, the sum of ``x`` over it."""
        out = np.zeros(self.n)
        for k, (some, at) in enumerate(self.levels):
            out[some] += x[at]
            if k + 1 < len(self.levels):
                x, half = x.copy(), x[1 << k :]
                x[: len(half)] += half
        return out

    def spread(self, c: np.ndarray) -> np.ndarray:
        """At each place, the sum of ``c`` over the ranges that hold it."""
        out = np.zeros(self.size)
        for k in reversed(range(len(self.levels))):
            some, at = self.levels[k]
            out += np.bincount(at, c[some], self.size)
            if k:
                half = 1 << k - 1
                out[half:] += out[:-half].copy()
        return out


def npmle(lo: np.ndarray, hi: np.ndarray, tol: float = 1e-10, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]:
    """Self-consistent masses on the innermost intervals, their log-likelihood, and whether it has settled within ``most`` rounds.

    An observation holds a contiguous range of innermost intervals, so a round of the self-consistency update costs (n + m) log m and no matrix is made. Pairs of rounds are
    extrapolated (Varadhan and Roland 2008) where that keeps all masses positive and does not lower the likelihood.
    """
    a, b = innermost(lo, hi)
    point = a == b
    at = np.searchsorted(a, lo, "left")
    open_at_point = (lo < hi) & (at < len(a)) & point[np.minimum(at, len(a) - 1)] & (a[np.minimum(at, len(a) - 1)] == lo)
    pairs, weight = np.unique(np.column_stack([at + open_at_point, np.searchsorted(b, hi, "right")]), axis=0, return_counts=True)
    held, n = Ranges(pairs[:, 0], pairs[:, 1], len(a)), weight.sum()

    def step(mass: np.ndarray) -> tuple[np.ndarray, float]:
        """The updated masses, and the log-likelihood of those given."""
        each = held.sums(mass)
        return mass * held.spread(weight / each) / n, float(weight @ np.log(each))

    mass, last = np.full(len(a), 1 / max(1, len(a))), -np.inf
    for _ in range(0, most, 3):
        one, value = step(mass)
        two, last = step(one)
        if last - value < tol:  # what one plain round adds
            return a, b, one, last, True
        r, v = one - mass, two - 2 * one + mass
        length = -np.sqrt((r @ r) / (v @ v)) if v @ v > 0 else -1.0
        mass = mass - 2 * length * r + length * length * v
        with np.errstate(divide="ignore", invalid="ignore"):
            best = step(mass)[1] if length < -1 and mass.min() > 0 else -np.inf
        if not best >= last:
            mass = two
    return a, b, mass, last, False


def turnbull(events: DataFrame, key: Sequence[str] = ("record", "label", "side")) -> DataFrame:
    """The nonparametric maximum likelihood estimate on interval-censored ages: key, lo, hi, mass, the survival after the interval, and the fit's log-likelihood and whether it converged."""
    key = list(key)

    def fit(rows: pa.Table) -> pa.Table:
        a, b, mass, value, settled = npmle(*(rows[c].to_numpy() for c in ("age_lo", "age_hi")))
        same = rows.select(key).take(pa.array(np.zeros(len(a), np.int64)))
        for name, v in (("lo", a), ("hi", b), ("mass", mass), ("survival_after", np.clip(1 - np.cumsum(mass), 0, 1)), ("log_likelihood", np.full(len(a), value)), ("converged", np.full(len(a), settled))):
            same = same.append_column(name, pa.array(v))
        return same

    schema = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in key) + ", lo double, hi double, mass double, survival_after double, log_likelihood double, converged boolean"
    return deal.by_key(events.select(*key, "age_lo", "age_hi"), *key).groupBy(*key).applyInArrow(fit, schema)


def q_interval(y: np.ndarray, v: np.ndarray, level: float) -> tuple[float, float]:
    """Interval of the between-record variance: where the generalised Q meets two chi-square quantiles."""
    k = len(y)

    def q(t: float) -> float:
        w = 1 / (v + t)
        return float((w * (y - (w * y).sum() / w.sum()) ** 2).sum())

    def root(target: float) -> float:
        if q(0.0) <= target:
            return 0.0
        top = max(1.0, float(v.max()))
        while q(top) > target:
            top *= 2
        return bisect(lambda t: target - q(t), 0.0, top)

    return root(chi2_quantile((1 + level) / 2, k - 1)), root(chi2_quantile((1 - level) / 2, k - 1))


def q_profile(means: DataFrame, key: Sequence[str], level: float = 0.95) -> DataFrame:
    """means: key, mean, var (a row a record) -> Q-profile interval of tau^2 and the prediction interval of a further record's mean."""
    key = list(key)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, v = pdf["mean"].to_numpy(float), pdf["var"].to_numpy(float)
        k = len(y)
        head = {x: [pdf[x].iloc[0]] for x in key}
        if k < 3:
            return pd.DataFrame(head | {"k": [k], "tau2_lower": [None], "tau2_upper": [None], "prediction_lower": [None], "prediction_upper": [None]})
        w = 1 / v
        q, c = float((w * (y - (w * y).sum() / w.sum()) ** 2).sum()), float(w.sum() - (w * w).sum() / w.sum())
        tau2 = max(0.0, (q - k + 1) / c)
        u = 1 / (v + tau2)
        mean, half = float((u * y).sum() / u.sum()), t_quantile((1 + level) / 2, k - 2) * float(np.sqrt(1 / u.sum() + tau2))
        low, high = q_interval(y, v, level)
        return pd.DataFrame(head | {"k": [k], "tau2_lower": [low], "tau2_upper": [high], "prediction_lower": [mean - half], "prediction_upper": [mean + half]})

    schema = ", ".join(f"{x} {means.schema[x].dataType.simpleString()}" for x in key) + ", k long, tau2_lower double, tau2_upper double, prediction_lower double, prediction_upper double"
    return means.filter("var > 0").select(*key, "mean", "var").groupBy(*key).applyInPandas(fit, schema)


def two_lobes(values: np.ndarray, seed: int = 0, rounds: int = 500) -> dict[str, float]:
    """Normal mixtures of one and two components by EM (several deterministic starts), compared by BIC."""
    x = np.asarray(values, float)
    n, var = len(x), max(float(np.var(x)), 1e-12)
    one = -0.5 * n * (np.log(2 * np.pi * var) + 1)
    # all starts at once (start, component, read); one whose likelihood has settled keeps what it has and leaves
    m, s, w = np.quantile(x, [[q, 1 - q] for q in (0.25, 0.1, 0.4)]), np.full((3, 2), var), np.full((3, 2), 0.5)
    going, last, ends = np.arange(3), np.full(3, -np.inf), np.full(3, -np.inf)
    final = [m.copy(), s.copy(), w.copy()]
    for _ in range(rounds):
        off = x - m[..., None]
        off *= off
        logs = off * (-0.5 / s)[..., None] + (np.log(w) - 0.5 * np.log(2 * np.pi * s))[..., None]
        low, high = np.minimum(logs[:, 0], logs[:, 1]), np.maximum(logs[:, 0], logs[:, 1])
        norm = high + np.log1p(np.exp(low - high))
        value = norm.sum(axis=1)
        r = np.exp(logs - norm[:, None])
        total = r.sum(axis=2) + 1e-12
        w, m = total / total.sum(axis=1, keepdims=True), r @ x / total
        off = x - m[..., None]
        s = np.maximum(np.einsum("scn,scn,scn->sc", r, off, off) / total, 1e-6 * var)
        ends[going] = value
        for whole, now in zip(final, (m, s, w), strict=True):
            whole[going] = now
        more = value - last >= 1e-9 * n
        if not more.all():
            going, m, s, w, value = going[more], m[more], s[more], w[more], value[more]
            if not len(going):
                break
        last = value
    best = int(np.argmax(ends))
    value, (m, s, w) = float(ends[best]), (v[best] for v in final)
    delta = (2 * np.log(n) - 2 * one) - (5 * np.log(n) - 2 * value)
    spread = float(np.sqrt((w * s).sum()))
    cut = float(m.mean())
    return {"bic_delta": float(delta), "bimodal": bool(delta > 6), "separation": float(abs(m[1] - m[0])), "spread": spread, "snr": float(abs(m[1] - m[0]) / spread) if spread > 0 else None, "low_mean": float(m.min()), "high_mean": float(m.max()), "cut": cut}


def two_lobe_fit(reads: DataFrame, least: int = 10) -> DataFrame:
    """Per record: is the value bimodal, and how far apart are the lobes."""

    names = ("bic_delta", "bimodal", "separation", "spread", "snr", "low_mean", "high_mean", "cut")
    kind = {c: pa.bool_() if c == "bimodal" else pa.float64() for c in names}

    def fit(rows: pa.Table) -> pa.Table:
        x = rows["value"].to_numpy()
        few = len(x) < least or len(np.unique(x[~np.isnan(x)])) < 2
        of = {} if few else two_lobes(x)
        return pa.table({"record": rows["record"].slice(0, 1), "n": [len(x)], "reason": ["too few distinct reads" if few else ""]} | {c: pa.array([of.get(c)], kind[c], from_pandas=True) for c in names})

    schema = "record long, n long, reason string, " + ", ".join(f"{c} {'boolean' if c == 'bimodal' else 'double'}" for c in names)
    return deal.by_key(reads.select("record", "value"), "record").groupBy("record").applyInArrow(fit, schema)
