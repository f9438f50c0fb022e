"""The two-pass running totals against one window a key, and that no window of a pooled curve sees a whole key."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidespan.operators import prefix, survival


def test_pieces_keep_the_order(spark):
    rng = random.Random(2)
    x = sorted([0.0, 1e-9, 1e-6, 1.0, 2.0, 1e9, *(rng.expovariate(1e-4) for _ in range(2000)), *(1 + i * 2.0**-52 for i in range(50))])
    got = [r.p for r in spark.createDataFrame([(v, i) for i, v in enumerate(x)], "x double, i long").select("i", prefix.piece("x").alias("p")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 500


def test_running_equals_one_window(spark):
    rng = random.Random(4)
    rows = [(k, float(x), rng.randint(0, 5), 1 - rng.random() / 9) for k in ("a", "b", None) for x in {round(rng.expovariate(1 / 50), 3) for _ in range(300)}]
    df = spark.createDataFrame([*rows, ("c", 5.0, 1, 0.5)], "k string, x double, n long, f double").withColumn("_at", F.lit("mine"))
    for down in (False, True):
        adds = {"s": (F.col("n"), "sum"), "p": (F.col("f"), "product")} | ({"next": (F.when(F.col("n") > 3, F.col("x")), "nearest")} if down else {})
        one, two = ({(r.k, r.x): r for r in prefix.running(df.drop("_at"), ["k"], "x", adds, down, pooled).collect()} for pooled in (False, True))
        assert one.keys() == two.keys() and len(one) == len(rows) + 1
        for key, r in one.items():
            assert r.s == two[key].s and np.isclose(r.p, two[key].p) and (not down or r.next == two[key].next)


def test_pooled_curves_equal_small_ones(spark):
    rng = random.Random(6)
    ev = spark.createDataFrame([("g", float(rng.choice([0.0, rng.expovariate(0.01), 7.0])), rng.random() < 0.6) for _ in range(900)], "k string, age double, event boolean")
    curves = [survival.product_limit(survival.risk_table(ev, ["k"], p), ["k"], p) for p in (False, True)]
    a, b = ([tuple(r) for r in c.select("age", "deaths", "censorings", "at_risk", "survival", "greenwood", "hazard", "hazard_var").orderBy("age").collect()] for c in curves)
    assert np.allclose(a, b, rtol=1e-12)
    for q in (0.1, 0.5, 0.9):
        assert survival.survival_quantile(curves[0], q, key=["k"]).first() == survival.survival_quantile(curves[1], q, key=["k"], pooled=True).first()
    one, two = (survival.restricted_mean(c, 150.0, ["k"], p).first() for c, p in zip(curves, (False, True)))
    assert np.isclose(one.rmst, two.rmst) and np.isclose(one.rmst_var, two.rmst_var)


def test_windows_see_pieces_only(spark):
    """Every window over the key alone runs on the totals of pieces."""
    ev = spark.range(1000).select(F.lit("g").alias("k"), (F.rand(1) * 100).alias("age"), (F.col("id") % 2 == 0).alias("event"))
    plan = survival.product_limit(survival.risk_table(ev, ["k"], True), ["k"], True)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*\], \[(.*?)\], \[(.*?)\]\n(.*)\n", plan)
    assert windows
    for keys, order, below in windows:
        assert "_piece" in keys or "_piece" in order, (keys, order)
