"""Permutation tests, distance correlation and batteries against direct computation."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest

from tidespan.operators import iterative, metrics, permutation, renewal, shape


def xi(x, y):
    n, o = len(x), np.argsort(x, kind="stable")
    r = np.array([(y <= v).sum() for v in y])
    at_least = np.array([(y >= v).sum() for v in y])
    return 1 - n * np.abs(np.diff(r[o])).sum() / (2 * (at_least * (n - at_least)).sum())


def dcor(x, y):
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
    return math.sqrt(max((a * b).mean(), 0) / math.sqrt((a * a).mean() * (b * b).mean()))


@pytest.mark.parametrize("n", [2, 3, 7, 64, 501])
def test_distance_correlation_has_no_limit_and_is_exact(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 9, n) + np.arange(n) % 2 * 0.5, rng.normal(size=n)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(2, 0, 1.0, 1.0)], "record long, seq long, x double, y double")
    got = {r.record: r for r in shape.distance_correlation(df, ["record"]).collect()}
    assert math.isclose(got[1].dcor, dcor(x, y), abs_tol=1e-9) and got[2].reason == "fewer than 2 pairs"


def test_small_groups_are_enumerated(spark):
    x, y = np.arange(5.0), np.array([2.0, 1, 4, 4, 7])
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(2, i, float(i), 1.0) for i in range(4)] + [(3, 0, 1.0, 2.0)], "record long, seq long, x double, y double")
    got = {(r.record, r.statistic): r for r in permutation.paired_permutation(df, ["record"], ("xi", "rho", "dcor")).collect()}
    all_ = [y[list(o)] for o in permutations(range(5))]
    for name, of in (("xi", xi), ("dcor", dcor)):
        seen = of(x, y)
        assert got[1, name].method == "exact" and math.isclose(got[1, name].p, np.mean([of(x, v) >= seen - 1e-12 for v in all_]))
    rank = lambda v: np.array([((v < z).sum() + (v <= z).sum() + 1) / 2 for z in v])
    assert math.isclose(got[1, "rho"].value, np.corrcoef(rank(x), rank(y))[0, 1])
    assert got[2, "xi"].method == "constant" and got[3, "rho"].method == "fewer than 3 pairs" and got[3, "rho"].p is None


def test_p_values_of_many_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=80)
    series = {1: x * x, 2: rng.normal(size=80), 3: np.round(x * x, 1)}
    rows = [(k, i, float(a), float(b)) for k, y in series.items() for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "record long, seq long, x double, y double")
    got = {r.record: r for r in permutation.xi_p_value(df, ["record"]).collect()}
    assert got[1].method == "normal" and got[3].method == "permutation" and got[1].p < 1e-4 and got[3].p == 0.001 and got[2].p > 0.01
    for k, y in series.items():
        assert math.isclose(got[k].xi, xi(x, y))
    assert sorted(map(tuple, permutation.xi_p_value(df, ["record"]).collect())) == sorted(map(tuple, got.values()))


def test_batteries_are_the_statistics_of_the_long_tables(spark):
    rng = np.random.default_rng(2)
    rows = []
    for record in range(4):
        for segment, n in enumerate([int(k) for k in rng.integers(3, 12, 3)]):
            x = np.round(rng.exponential(size=n), 1) + 0.1
            rows += [(record, "r", "s", segment, i + 1, float(v), float(x.sum() + (0 if segment else 2)), n) for i, v in enumerate(x)]
    gaps = renewal.usable(spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double, n long").drop("n"))
    ranked = renewal.draws(renewal.mid_ranks(gaps), 12, 5)
    want = {(r.record, r.b): r for r in renewal.trend_statistics(ranked, renewal.gamma(gaps)).collect()}
    more = {(r.record, r.b): r for r in renewal.dependence_statistics(renewal.rank_autocorrelation(ranked)).collect()}
    got = renewal.battery(gaps, 12, 5).collect()
    assert len(got) == len(want) == 52
    for r in got:
        a, b = want[r.record, r.b], more[r.record, r.b]
        assert np.allclose((r.n_segments, r.n_events, r.c1, r.c2, r.cvm, r.c5, r.c6), (a.n_segments, a.n_events, a.c1, a.c2, a.cvm, b.c5, b.c6))


def test_exact_observations_close_intervals():
    assert [list(map(float, v)) for v in iterative.innermost(np.array([1.0, 2]), np.array([2.0, 2]))] == [[2.0], [2.0]]
    a, b, mass, value, settled = iterative.npmle(np.array([1.0, 2]), np.array([2.0, 2]))
    assert settled and list(mass) == [1.0] and value == 0


def test_unix_seconds(spark):
    df = spark.createDataFrame([(1.7e9,), (1.7e12,), (None,), (-1.0,), (946684800.0,)], "x double")
    assert [r[0] for r in df.select(metrics.plausible_unix_s(df.x)).collect()] == [True, False, False, False, True]


def test_draws_of_distance_correlation_share_one_matrix(monkeypatch):
    """Short series take no n log^2 n pass a draw, and give the numbers of the plain definition."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=40), np.round(rng.exponential(size=40), 1)
    orders = np.stack([np.arange(40), *(rng.permutation(40) for _ in range(30))])
    assert np.allclose(shape.distance_correlations(x, y, orders, 0), [dcor(x, y[o]) for o in orders])
    monkeypatch.setattr(shape, "product_of_distances", lambda *_: pytest.fail("a pass for one draw"))
    assert np.allclose(shape.distance_correlations(x, y, orders), [dcor(x, y[o]) for o in orders])
    assert permutation.upper_p(x, np.ones(40), "dcor", 99, rng)[2] == "constant"
    seen, p, method = permutation.upper_p(x, y, "dcor", 99, np.random.default_rng(8))
    again = np.concatenate([[dcor(x, y[o]) for o in block] for block in permutation.orders(40, 99, np.random.default_rng(8))])
    assert method == "permutation" and math.isclose(seen, dcor(x, y)) and p == (1 + (again >= seen - 1e-12).sum()) / 100


def test_draws_are_dealt_over_all_cores(spark):
    df = spark.range(40).selectExpr("id % 8 as record", "id as seq", "cast(id as double) as x", "cast(id * id % 7 as double) as y")
    out = permutation.paired_permutation(df, ["record"], ("xi",), draws=9)
    assert out.count() == 8 and out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_starts_of_a_mixture_go_together_and_settle_alone(monkeypatch):
    """One round serves all starts, so a fit takes no more rounds than its slowest start; each start ends where it would by itself."""
    def plain(x, q, rounds=500):
        var, last, counted = np.var(x), -np.inf, 0
        m, s, w = np.quantile(x, [q, 1 - q]), np.array([var, var]), np.array([0.5, 0.5])
        for _ in range(rounds):
            counted += 1
            logs = np.log(w) - 0.5 * (np.log(2 * np.pi * s) + (x[:, None] - m) ** 2 / s)
            norm = np.logaddexp(logs[:, 0], logs[:, 1])
            r, value = np.exp(logs - norm[:, None]), norm.sum()
            total = r.sum(axis=0) + 1e-12
            w, m = total / total.sum(), (r * x[:, None]).sum(axis=0) / total
            s = np.maximum((r * (x[:, None] - m) ** 2).sum(axis=0) / total, 1e-6 * var)
            if value - last < 1e-9 * len(x):
                break
            last = value
        return value, m, counted

    rng, rounds = np.random.default_rng(12), []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: rounds.append(1) or einsum(*a))
    for x in (rng.exponential(40, 70), np.r_[rng.normal(0, 1, 30), rng.normal(9, 2, 20)], rng.normal(size=12), np.r_[np.zeros(11), 1.0]):
        rounds.clear()
        got, want = iterative.two_lobes(x), [plain(x, q) for q in (0.25, 0.1, 0.4)]
        value, m, _ = max(want, key=lambda v: v[0])
        one = -0.5 * len(x) * (np.log(2 * np.pi * np.var(x)) + 1)
        assert np.isclose(got["bic_delta"], 2 * value - 2 * one - 3 * np.log(len(x)), rtol=1e-9, atol=1e-8) and np.isclose(got["separation"], abs(m[1] - m[0]))
        assert len(rounds) == max(v[2] for v in want)
