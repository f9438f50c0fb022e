"""Spectra up to the band edge and Allan deviations at all factors, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidespan.functions.fourier import exponential_sums
from tidespan.operators import carve, resolve

RNG = np.random.default_rng(4)
T = np.cumsum(RNG.integers(500_000, 1_500_000, 90))
V = np.sin(2 * np.pi * 35 * (T - T[0]) / (T[-1] - T[0])) + 0.1 * RNG.normal(size=90)
FS = 1e6 / np.median(np.diff(T))


def obs(spark):
    rows = [(1, int(t), i, float(v), 0.1) for i, (t, v) in enumerate(zip(T, V))]
    return carve.observed_reads(spark.createDataFrame(rows, "record long, t_us long, seq long, value double, sigma double"))


def test_fast_sums_equal_direct_sums():
    for n, top in ((1, 1), (3, 2), (90, 45), (90, 91), (2000, 2501)):
        x, c = RNG.random(n), RNG.normal(size=n) + 1j * RNG.normal(size=n)
        x[-1] = 1.0
        assert np.abs(exponential_sums(x, c, top) - np.exp(-2j * np.pi * np.outer(np.arange(top + 1), x)) @ c).max() < 1e-11 * np.abs(c).sum()


def test_records_without_a_spectrum(spark):
    rows = [(1, 5, 0, 1.0), (2, 5, 0, 1.0), (2, 9, 1, 2.0), *((3, 10 * i, i, 7.0) for i in range(9)), *((4, 10, i, float(i)) for i in range(9)), *((5, 10 * (i // 2), i, float(i % 2)) for i in range(20))]
    o = carve.observed_reads(spark.createDataFrame(rows, "record long, t_us long, seq long, value double").withColumn("sigma", F.lit(0.1)))
    assert resolve.lomb_scargle(o).count() == 0  # one read, two reads, one value, one time, equal means
    assert {r.record for r in resolve.spectral_window(o).select("record").distinct().collect()} == {3, 5}
    assert {r.record for r in resolve.band_maximum(o).collect()} == {2, 3, 5}


def test_spectra_reach_the_band_edge(spark):
    t, span = (T - T[0]) / 1e6, (T[-1] - T[0]) / 1e6
    top = int(np.floor(span * FS / 2))
    got = {r.k: r.density for r in resolve.lomb_scargle(obs(spark)).collect()}
    assert sorted(got) == list(range(1, top + 1)) and top > 35 and max(got, key=got.get) == 35
    for k in got:
        x = np.column_stack([np.ones(90), np.cos(2 * np.pi * k * t / span), np.sin(2 * np.pi * k * t / span)])
        rest = V - x @ np.linalg.lstsq(x, V, rcond=None)[0]
        power = (((V - V.mean()) ** 2).sum() - (rest**2).sum()) / 2
        assert np.isclose(got[k], 2 / FS * power, rtol=1e-6, atol=1e-9)
    window = {r.k: r.window for r in resolve.spectral_window(obs(spark)).collect()}
    assert sorted(window) == sorted(got) and all(np.isclose(w, abs(np.exp(-2j * np.pi * k / span * t).sum()) ** 2 / 8100) for k, w in window.items())
    steps = 2 * int(np.ceil(2 * span * FS))
    want = max(abs(np.exp(-2j * np.pi * FS * (0.5 + i / steps) * t).sum()) ** 2 / 8100 for i in range(steps + 1))
    assert np.isclose(resolve.band_maximum(obs(spark)).first().maximum, want)


def test_allan_deviation_has_all_factors(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 8)
    got = {r.m: (r.n_terms, r.adev) for r in resolve.allan_deviation(obs(spark)).collect()}
    x = np.concatenate([[0.0], np.cumsum(V - V.mean())])
    want = {m: x[2 * m :] - 2 * x[m:-m] + x[: -2 * m] for m in range(1, 46)}
    assert sorted(got) == [m for m, d in want.items() if len(d) >= 8] and max(got) > 16
    assert all(n == len(want[m]) and np.isclose(a, np.sqrt((want[m] ** 2).sum() / (2 * m * m * n))) for m, (n, a) in got.items())
    some = {r.m: r.adev for r in resolve.allan_deviation(obs(spark), octaves=True).collect()}
    assert sorted(some) == [1, 2, 4, 8, 16, 32] and all(np.isclose(a, got[m][1]) for m, a in some.items())
