"""The interval-censored estimate: against the matrix form, by its optimality conditions, and on a million windows."""

from __future__ import annotations

import resource

import numpy as np

from tidespan.operators import iterative


def matrix(lo, hi, rounds=200_000, tol=1e-12):
    """The update on the whole matrix of observations and innermost intervals."""
    a, b = iterative.innermost(lo, hi)
    point = (a == b)[None, :]
    inside = np.where(point, (a > lo[:, None]) & (a <= hi[:, None]), (a >= lo[:, None]) & (b <= hi[:, None]))
    inside = np.where((lo == hi)[:, None], point & (a == lo[:, None]), inside).astype(float)
    m, last = np.full(len(a), 1 / len(a)), -np.inf
    for _ in range(rounds):
        each = inside @ m
        if (value := np.log(each).sum()) - last < tol:
            break
        last, m = value, m * ((1 / each) @ inside) / len(lo)
    return inside, m, last


def cases():
    rng = np.random.default_rng(5)
    for k in range(60):
        n = int(rng.integers(1, 40))
        lo = np.round(rng.exponential(3, n), int(rng.integers(0, 3)))
        hi = lo + np.where(rng.random(n) < 0.3, 0.0, np.round(rng.exponential(2, n), int(rng.integers(0, 3))))
        yield lo, np.where(rng.random(n) < 0.3, np.inf, hi)
    yield np.array([1.0, 1.0]), np.array([1.0, 2.0])  # an exact time where an open interval begins
    yield np.array([0.0, 0.0, 1.0]), np.array([1.0, 2.0, 2.0])


def test_equal_to_the_matrix_and_optimal():
    for lo, hi in cases():
        inside, want, top = matrix(lo, hi)
        _, _, mass, value, settled = iterative.npmle(lo, hi)
        assert settled and np.isclose(mass.sum(), 1) and value >= top - 1e-6
        score = (1 / (inside @ mass)) @ inside / len(lo)
        assert score.max() < 1 + 1e-3 and np.allclose(score[mass > 1e-3], 1, atol=1e-3)
        assert np.allclose(inside @ mass, inside @ want, atol=1e-3)  # masses themselves need not be unique


def test_ranges_are_sums_and_their_adjoint():
    rng = np.random.default_rng(6)
    for size in (1, 2, 7, 64, 100):
        first = rng.integers(0, size, 50)
        last = np.array([rng.integers(f + 1, size + 1) for f in first])
        x, c, held = rng.random(size), rng.random(50), iterative.Ranges(first, last, size)
        assert np.allclose(held.sums(x), [x[f:e].sum() for f, e in zip(first, last)])
        assert np.allclose(held.spread(c), [c[(first <= j) & (j < last)].sum() for j in range(size)])


def test_a_million_windows_in_one_cell():
    rng = np.random.default_rng(7)
    lo = rng.exponential(100, 1_000_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    a, _, mass, _, _ = iterative.npmle(lo, np.where(rng.random(len(lo)) < 0.2, np.inf, lo + rng.random(len(lo))), most=6)
    assert len(a) > 100_000 and np.isclose(mass.sum(), 1) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 3_000_000


def test_fits_are_dealt_over_all_cores(spark):
    from tidespan.operators import iterative

    df = spark.range(60).selectExpr("id % 6 as record", "'r' as label", "'s' as side", "cast(id as double) as age_lo", "cast(id + 1 as double) as age_hi", "cast(id * id % 17 as double) as value")
    for out in (iterative.turnbull(df), iterative.two_lobe_fit(df)):
        assert out.select("record").distinct().count() == 6 and out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fits_come_through_arrow(spark):
    """A cell costs its fit, not the making of pandas frames; open ends and the key's kinds stay."""
    df = spark.createDataFrame([(k, "r", f"s{k % 2}", float(i * i % 7), float("inf") if i % 3 == 0 else float(i * i % 7 + 1 + k)) for k in range(4) for i in range(9)], "record int, label string, side string, age_lo double, age_hi double")
    out = iterative.turnbull(df)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString() and out.schema["record"].dataType.simpleString() == "int"
    got = {}
    for r in out.orderBy("record", "side", "lo", "hi").collect():
        got.setdefault((r.record, r.label, r.side), []).append(r)
    assert set(got) == {(k, "r", f"s{k % 2}") for k in range(4)}
    for (k, _, _), rows in got.items():
        lo, hi = (np.array([v[i] for v in df.filter(f"record = {k}").select("age_lo", "age_hi").collect()]) for i in (0, 1))
        a, b, mass, value, settled = iterative.npmle(lo, hi)
        assert np.allclose([(r.lo, r.mass, r.survival_after, r.log_likelihood) for r in rows], np.column_stack([a, mass, np.clip(1 - np.cumsum(mass), 0, 1), np.full(len(a), value)]))
        assert [r.hi for r in rows] == list(b) and all(r.converged == settled for r in rows)
