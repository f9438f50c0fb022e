"""Survival estimators against literals and plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.functions import special
from tidespan.operators import iterative, survival

KEY = ("record", "label", "side")


def table(spark, rows):
    return spark.createDataFrame([("r", "l", "s", float(a), bool(e), float(a), float(a) if e else float("inf")) for a, e in rows], "record string, label string, side string, age double, event boolean, age_lo double, age_hi double")


def curve(spark, rows):
    return survival.product_limit(survival.risk_table(table(spark, rows)))


def test_product_limit_with_ties_and_censoring(spark):
    rows = [(1, True), (2, True), (2, False), (3, True), (4, False), (5, True)]
    got = [(r.age, r.at_risk, round(r.survival, 6)) for r in curve(spark, rows).orderBy("age").collect()]
    assert got == [(1.0, 6, 0.833333), (2.0, 5, 0.666667), (3.0, 3, 0.444444), (4.0, 2, 0.444444), (5.0, 1, 0.0)]


def test_uncensored_curve_is_the_empirical_law(spark):
    rng = random.Random(1)
    ages = [rng.randint(1, 9) for _ in range(50)]
    for r in curve(spark, [(a, True) for a in ages]).collect():
        assert math.isclose(r.survival, 1 - sum(a <= r.age for a in ages) / 50, abs_tol=1e-12)


def test_band_holds_the_curve(spark):
    for r in survival.loglog_band(curve(spark, [(a, a % 3 > 0) for a in range(1, 30)])).collect():
        if 0 < r.survival < 1:
            assert r.lower <= r.survival <= r.upper


def test_quantile_takes_the_midpoint_on_an_exact_hit(spark):
    c = curve(spark, [(1, True), (2, True), (4, True), (8, True)])
    assert survival.survival_quantile(c, 0.5).first().quantile == 3.0
    assert survival.survival_quantile(c, 0.6).first().quantile == 4.0


def test_restricted_mean_is_the_area(spark):
    c = curve(spark, [(1, True), (2, True), (4, True), (8, True)])
    r = survival.restricted_mean(c, 5.0).first()
    assert math.isclose(r.rmst, 1 + 0.75 + 2 * 0.5 + 1 * 0.25)
    areas = {1: 0.75 + 1.0 + 0.25, 2: 1.0 + 0.25, 4: 0.25}
    assert math.isclose(r.rmst_var, areas[1] ** 2 / (4 * 3) + areas[2] ** 2 / (3 * 2) + areas[4] ** 2 / (2 * 1))


def test_nelson_aalen(spark):
    h = [r.hazard for r in curve(spark, [(1, True), (2, True), (3, False)]).orderBy("age").collect()]
    assert np.allclose(h, [1 / 3, 1 / 3 + 1 / 2, 1 / 3 + 1 / 2])


def test_step_evaluation_is_right_continuous(spark):
    c = curve(spark, [(1, True), (2, True)])
    at = c.select(*KEY).distinct().select(*KEY, F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 9.0)])).alias("at"))
    assert [r.survival for r in survival.step_at(c, at).orderBy("at").collect()] == [1.0, 0.5, 0.5, 0.0]


def test_log_rank_by_hand(spark):
    rows = [("a", 1, True), ("a", 3, True), ("b", 2, True), ("b", 4, False)]
    df = spark.createDataFrame([("k", g, float(x), e) for g, x, e in rows], "k string, g string, age double, event boolean")
    r = survival.log_rank(df, "g", "a", "b", ["k"]).first()
    assert math.isclose(r.o_minus_e, 2 - (2 / 4 + 1 / 3 + 1 / 2)) and math.isclose(r.variance, 1 / 4 + 2 / 9 + 1 / 4)


def test_event_tables_are_checked(spark):
    bad = table(spark, [(1, True)]).withColumn("age", F.lit(-1.0))
    assert survival.event_table_errors(bad).count() == 1 and survival.event_table_errors(table(spark, [(1, True)])).isEmpty()


def test_turnbull_without_overlap_is_the_empirical_law():
    a, b, mass, _, settled = iterative.npmle(np.array([0.0, 2.0, 4.0]), np.array([1.0, 3.0, 5.0]))
    assert list(zip(a, b)) == [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)] and np.allclose(mass, 1 / 3)


def test_turnbull_with_right_censoring_is_product_limit(spark):
    rows = [(1, True), (2, False), (3, True), (4, False)]
    lo = np.array([float(a) for a, _ in rows])
    hi = np.array([float(a) if e else np.inf for a, e in rows])
    a, b, mass, _, settled = iterative.npmle(lo, hi)
    kept = {r.age: r.survival for r in curve(spark, rows).collect()}
    assert math.isclose(1 - sum(m for m, y in zip(mass, b) if y <= 1), kept[1.0], abs_tol=1e-6)
    assert math.isclose(1 - sum(m for m, y in zip(mass, b) if y <= 3), kept[3.0], abs_tol=1e-6)


def test_pooling_of_equal_means(spark):
    df = spark.createDataFrame([("k", 10.0, v) for v in (1.0, 2.0, 4.0)], "key string, mean double, var double")
    r = survival.pool_random_effects(df, ["key"]).first()
    assert r.tau2 == 0 and math.isclose(r.pooled, 10.0) and math.isclose(r.se, (1 + 0.5 + 0.25) ** -0.5)
    assert iterative.q_profile(df, ["key"]).first().tau2_lower == 0


@pytest.mark.parametrize("p,k,want", [(0.95, 1, 3.841459), (0.975, 5, 12.8325), (0.05, 10, 3.940299)])
def test_chi_square_quantiles(p, k, want):
    assert math.isclose(special.chi2_quantile(p, k), want, rel_tol=1e-5)


@pytest.mark.parametrize("p,k,want", [(0.975, 1, 12.7062), (0.975, 10, 2.228139), (0.95, 30, 1.697261)])
def test_t_quantiles(p, k, want):
    assert math.isclose(special.t_quantile(p, k), want, rel_tol=1e-5)


def test_limiting_laws_at_tabulated_points():
    assert abs(special.cvm_cdf(0.46136) - 0.95) < 2e-4 and abs(special.cvm_cdf(0.74346) - 0.99) < 2e-4
    assert abs(special.ad_cdf(2.492) - 0.95) < 1e-3 and abs(special.ad_cdf(3.857) - 0.99) < 1e-3
