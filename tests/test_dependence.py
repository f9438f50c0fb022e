"""The dependence panel: members against their definitions, the panel's p, and reasons."""

from __future__ import annotations

import numpy as np

from tidespan.operators import dependence, shape

RNG = np.random.default_rng(9)


def reads(spark, series):
    rows = [(k, i, i, float(q), None if s is None else float(s)) for k, (qs, ss) in series.items() for i, (q, s) in enumerate(zip(qs, ss, strict=True))]
    return spark.createDataFrame(rows, "record long, t_us long, seq long, value double, sigma double")


def test_members_are_their_definitions():
    q, s = RNG.normal(size=60), np.round(RNG.exponential(size=60), 1)
    orders = np.stack([np.arange(60), *(RNG.permutation(60) for _ in range(5))])
    got = dependence.members_of(q, s, orders)
    mid = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for k, o in enumerate(orders):
        y = s[o]
        assert np.isclose(got["pearson_abs"][k], abs(np.corrcoef(q, y)[0, 1])) and np.isclose(got["spearman_abs"][k], abs(np.corrcoef(mid(q), mid(y))[0, 1]))
        assert np.isclose(got["distance_correlation"][k], shape.distance_correlation_of(q, y))
        by = y[np.argsort(q)]
        r, least = np.array([(by <= v).sum() for v in by]), np.array([(by >= v).sum() for v in by])
        assert np.isclose(got["chatterjee_xi"][k], 1 - 60 * np.abs(np.diff(r)).sum() / (2 * (least * (60 - least)).sum()))
        means = by.reshape(10, 6).mean(axis=1)
        assert np.isclose(got["decile_spread"][k], (means.max() - means.min()) / s.mean())


def test_long_series_give_the_same_numbers(monkeypatch):
    q, s = RNG.normal(size=80), RNG.exponential(size=80)
    orders = np.stack([np.arange(80), RNG.permutation(80)])
    matrix = dependence.members_of(q, s, orders)["distance_correlation"]
    monkeypatch.setattr(dependence, "MATRIX", 10)
    assert np.allclose(matrix, dependence.members_of(q, s, orders)["distance_correlation"])


def test_panel_finds_dependence_and_names_it(spark):
    q = RNG.normal(size=150)
    df = reads(spark, {1: (q, 0.1 + q * q), 2: (q, RNG.exponential(size=150)), 3: (q[:9], np.abs(q[:9])), 4: (q[:20], [None] * 20), 5: (q[:20], np.ones(20)), 6: (q[:20], -np.abs(q[:20])), 7: (np.r_[q[:40], [np.nan] * 5], np.abs(np.r_[q[:40], q[:5]]))})
    got = {}
    for r in dependence.panel(df, 199).collect():
        got.setdefault(r.record, []).append(r)
    assert {k: v[0].reason for k, v in got.items()} == {1: "", 2: "", 3: "fewer than 10 reads", 4: "no read with a known sigma", 5: "zero variance", 6: "a sigma is negative", 7: ""}
    one = {r.member: r for r in got[1]}
    assert one["chatterjee_xi"].p == 1 / 200 and one["chatterjee_xi"].attains and one["chatterjee_xi"].panel_p <= 0.02 and one["pearson_abs"].p > 0.005
    assert got[7][0].n == 40 and got[2][0].panel_p > 0.02
    for rows in got.values():
        p = [r.p for r in rows if r.p is not None]
        assert all(r.attains == (r.p == min(p)) for r in rows if r.p is not None) and all(rows[0].panel_p >= min(p) for _ in p)
    again = {(r.record, r.member): r.p for r in dependence.panel(df.orderBy("value"), 199).collect()}
    assert again == {(r.record, r.member): r.p for rows in got.values() for r in rows}


def test_panel_holds_its_size(spark):
    rng = np.random.default_rng(1)
    df = reads(spark, {k: (rng.normal(size=30), rng.exponential(size=30)) for k in range(200)})
    p = [r.panel_p for r in dependence.panel(df, 99).filter("member = 'pearson_abs'").collect()]
    assert len(p) == 200 and abs(np.mean(np.array(p) <= 0.1) - 0.1) < 0.07


def test_tellability_reads_one_spectrum(spark):
    """The noise floor and the tenth's ratio come from one spectrum a record, as each does alone."""
    import math

    from tidespan.operators import carve, panels, resolve

    rng = np.random.default_rng(9)
    rows = [(k, int(t), i, float(v), None if k == 2 else 0.1 * float(v)) for k, n in enumerate((40, 2, 30, 12)) for i, (t, v) in enumerate(zip(np.cumsum(rng.integers(1, 9, n)) * 1_000_000, rng.exponential(size=n)))]
    rows += [(7, i * 1_000_000, i, 3.0, 0.1) for i in range(12)]
    obs = carve.observed_reads(spark.createDataFrame(rows, "record long, t_us long, seq long, value double, sigma double"))
    whole = panels.tellability(obs)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 2  # the spectrum and the band's maximum
    spectrum = resolve.lomb_scargle(obs)
    floor = {r.record: r.ratio for r in panels.noise_floor(obs, spectrum).collect()}
    tenth = {r.record: r.g10 for r in panels.tenth_ratio(resolve.derivative_variance(spectrum)).collect()}
    same = lambda a, b: a is None and b is None or math.isclose(a, b, rel_tol=1e-12)
    got = whole.collect()
    assert len(got) == 5 and all(same(r.noise_floor_ratio, floor.get(r.record)) and same(r.g10, tenth.get(r.record)) for r in got)
    assert sum(r.g10 is not None for r in got) >= 3 and sum(r.noise_floor_ratio is not None for r in got) >= 2


def test_the_bump_is_transformed_once_a_grid():
    from tidespan.functions import fourier

    rng = np.random.default_rng(2)
    for n, top in ((9, 40), (30, 41), (30, 57), (5, 5000)):
        x, c = rng.random(n), rng.normal(size=n)
        assert np.allclose(fourier.exponential_sums(x, c, top), [(c * np.exp(-2j * np.pi * k * x)).sum() for k in range(top + 1)], atol=1e-11)
    made = fourier._kept_transform.cache_info().misses
    for top in range(40, 58):
        fourier.exponential_sums(x, c, top)
    assert fourier._kept_transform.cache_info().misses <= made + 1
