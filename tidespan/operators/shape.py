"""Shape of windows and dependence between two series: Chatterjee's xi, Spearman, distance correlation, shape curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chatterjee(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """pairs: key, seq, x, y -> xi with the tie correction; null for fewer than three pairs or a constant y. Order by x, ties by seq."""
    w = Window.partitionBy(*key)
    at_most = F.count("*").over(w.orderBy("y").rangeBetween(Window.unboundedPreceding, 0))
    at_least = F.count("*").over(w.orderBy(F.col("y").desc()).rangeBetween(Window.unboundedPreceding, 0))
    rows = pairs.withColumn("r", at_most).withColumn("l", at_least).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("step", F.abs(F.lead("r").over(w.orderBy("x", "seq")) - F.col("r")))
    out = rows.groupBy(*key).agg(F.first("n").alias("n"), F.sum("step").alias("s"), F.sum(F.col("l") * (F.col("n") - F.col("l"))).alias("d"))
    return out.withColumn("xi", F.when((F.col("n") >= 3) & (F.col("d") > 0), 1 - F.col("n") * F.col("s") / F.nullif(2.0 * F.col("d"), F.lit(0.0)))).drop("s", "d")


def spearman(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Correlation of mid-ranks; null for fewer than three pairs or a constant side."""
    w = Window.partitionBy(*key)
    mid = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*key, c)) - 1) / 2
    rows = pairs.withColumn("rx", mid("x")).withColumn("ry", mid("y"))
    cov, vx, vy = F.covar_pop("rx", "ry"), F.var_pop("rx"), F.var_pop("ry")
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & (vx > 0) & (vy > 0), cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("rho"))


def product_of_distances(x: np.ndarray, y: np.ndarray) -> float:
    """The sum of |x_i - x_j| |y_i - y_j| over all ordered pairs in n log^2 n: in the order of x, blocks of doubling width meet their neighbours, sorted by y."""
    n, order = len(x), np.argsort(x, kind="stable")
    x, y, place, total, width = x[order], y[order], np.arange(len(x)), 0.0, 1
    while width < n:
        pair = place // (2 * width)
        by = np.lexsort((y, pair))
        left = (by // width) % 2 == 0
        parts = np.stack([np.ones(n), x[by], y[by], x[by] * y[by]]) * left
        run = np.concatenate([np.zeros((4, 1)), np.cumsum(parts, axis=1)], axis=1)
        starts = np.searchsorted(pair, np.arange(pair[-1] + 2))  # by keeps the pairs in their places
        below = run[:, 1:] - run[:, starts[pair]]
        whole = run[:, starts[pair + 1]] - run[:, starts[pair]]
        gain = lambda s: s[0] * x[by] * y[by] - x[by] * s[2] - y[by] * s[1] + s[3]
        total += float(((gain(below) - gain(whole - below)) * ~left).sum())
        width *= 2
    return 2 * total


def sums_of_distances(x: np.ndarray) -> np.ndarray:
    """For each value the sum of its distances to all others."""
    n, order = len(x), np.argsort(x, kind="stable")
    s, out = x[order], np.empty(len(x))
    run = np.cumsum(s)
    k = np.arange(1, n + 1)
    out[order] = s * (2 * k - n) - 2 * run + run[-1]
    return out


#: Pairs up to which the distances of a series are held as a matrix, and the numbers in a slice of shuffled series beside it.
MATRIX, SLICE = 512, 65_536


def _products_of_distances(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row of ``rows`` the mean product of the centred distances of x with the row's distances: one centred matrix of x, one pass over i < j for a slice of rows."""
    n, out = len(x), np.zeros(len(rows))
    d = np.abs(x[:, None] - x)
    d = d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()
    step = max(1, SLICE // n)
    for low in range(0, len(rows), step):
        y = np.ascontiguousarray(rows[low : low + step].T)
        room = np.empty_like(y)
        for i in range(n - 1):
            far = np.subtract(y[i + 1 :], y[i], out=room[i + 1 :])
            out[low : low + step] += d[i, i + 1 :] @ np.abs(far, out=far)
    return 2 * out / n**2


def distance_correlations(x: np.ndarray, y: np.ndarray, orders: np.ndarray, matrix: int | None = None) -> np.ndarray:
    """V-statistic distance correlation of x with y in each order (a row of places); not a number where one of them is constant. The sums of distances and both
    scales do not depend on the order, so they are found once. Series beyond ``matrix`` take n log^2 n an order."""
    n, x, y = len(x), x - x.mean(), y - y.mean()
    a, b = sums_of_distances(x), sums_of_distances(y)
    part = lambda u, v, both: both / n**2 - 2 * float(u @ v) / n**3 + float(u.sum()) * float(v.sum()) / n**4
    va, vb = part(a, a, 2 * n * float(x @ x) - 2 * float(x.sum()) ** 2), part(b, b, 2 * n * float(y @ y) - 2 * float(y.sum()) ** 2)
    if not (va > 1e-18 and vb > 1e-18):
        return np.full(len(orders), np.nan)
    both = _products_of_distances(x, y[orders]) if n <= (MATRIX if matrix is None else matrix) else np.array([part(a, b[o], product_of_distances(x, y[o])) for o in orders])
    return np.sqrt(np.maximum(both, 0.0) / math.sqrt(va * vb))


def distance_correlation_of(x: np.ndarray, y: np.ndarray) -> float | None:
    """V-statistic distance correlation of two series; None where one is constant."""
    d = float(distance_correlations(x, y, np.arange(len(x))[None, :], 0)[0])
    return None if math.isnan(d) else d


def distance_correlation(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distance correlation of each group's pairs (x, y), a group's arrays at a time; a reason where there is none."""

    def run(group: pa.Table) -> pa.Table:
        n = group.num_rows
        d = distance_correlation_of(group.column("x").to_numpy(), group.column("y").to_numpy()) if n >= 2 else None
        reason = "fewer than 2 pairs" if n < 2 else "constant" if d is None else ""
        return pa.table({**{k: group.column(k).slice(0, 1) for k in key}, "n": [n], "dcor": pa.array([d], pa.float64()), "reason": [reason]})

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key) + ", n long, dcor double, reason string"
    return pairs.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(*key).applyInArrow(run, schema)


def tie_fraction(pairs: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    k = F.count("*").over(Window.partitionBy(*key, column))
    return pairs.withColumn("k", k).groupBy(*key).agg(F.avg((F.col("k") > 1).cast("double")).alias("tied"))


def window_shape(reads: DataFrame, least: int = 5) -> DataFrame:
    """Per complete window of ``least`` reads or more: where its margin peaks, the peak and mean margin, and rho of margin with the time left and on each limb."""
    key = ["record", "label", "island"]
    rows = reads.filter("age_s is not null").withColumn("n", F.count("*").over(Window.partitionBy(*key))).filter(F.col("n") >= least)
    peak = rows.groupBy(*key).agg(F.max(F.struct("margin", (-F.col("t_us")).alias("m"))).alias("p"), F.first("n").alias("n"), F.avg("margin").alias("mean_margin"), F.max(F.col("age_s") + F.col("left_s")).alias("length_s"), F.min("birth_us").alias("b"))
    rho = spearman(rows.select(*key, "seq", F.col("margin").alias("x"), F.col("left_s").alias("y")), key)
    out = peak.join(rho.select(*key, "rho"), key)
    age = (-F.col("p.m") - F.col("b")) / 1e6
    return out.select(*key, "n", F.col("p.margin").alias("peak_margin"), "mean_margin", F.try_divide(age, F.col("length_s")).alias("peak_fraction"), "rho", (F.col("rho") * F.col("rho")).alias("rho2"))


def pooled_shape(reads: DataFrame) -> DataFrame:
    """xi and rho of the margin with the time left, over the reads of all complete windows of a record and rung."""
    key = ["record", "label"]
    rows = reads.filter("age_s is not null").select(*key, "seq", F.col("margin").alias("x"), F.col("left_s").alias("y"))
    return chatterjee(rows, key).join(spearman(rows, key).select(*key, "rho"), key)


def shape_medians(shapes: DataFrame) -> DataFrame:
    """Medians over the windows of a record and rung."""
    return shapes.groupBy("record", "label").agg(
        F.count("*").alias("n_windows"), F.median("n").alias("median_reads"), F.median("peak_margin").alias("median_peak"), F.median("mean_margin").alias("median_mean"), F.median("peak_fraction").alias("median_peak_fraction"), F.median("rho").alias("median_rho")
    )


def shape_curve(reads: DataFrame, points: int = 25, least: int = 5) -> DataFrame:
    """Mean and standard error of margins at equal steps of window age, each window scaled to unit age and its own peak, interpolated between the reads around each point."""
    key = ["record", "label", "island"]
    w = Window.partitionBy(*key)
    rows = reads.filter("age_s is not null and margin >= 0").withColumn("n", F.count("*").over(w)).withColumn("last", F.max("age_s").over(w)).withColumn("peak", F.max("margin").over(w)).filter((F.col("n") >= least) & (F.col("last") > 0) & (F.col("peak") > 0))
    o = w.orderBy("t_us", "seq")
    seg = rows.withColumn("a", F.col("age_s") / F.col("last")).withColumn("m", F.col("margin") / F.col("peak"))
    seg = seg.withColumn("a1", F.lead("a").over(o)).withColumn("m1", F.lead("m").over(o)).filter("a1 is not null and a1 > a")
    step = points - 1
    k = F.explode(F.expr(f"filter(sequence(cast(ceil(a * {step}) as int), cast(floor(a1 * {step}) as int), 1), x -> x < a1 * {step} or a1 >= 1)"))
    seg = seg.filter(F.ceil(F.col("a") * step) <= F.floor(F.col("a1") * step)).withColumn("k", k)
    at = seg.withColumn("y", F.col("m") + (F.col("k") / step - F.col("a")) / (F.col("a1") - F.col("a")) * (F.col("m1") - F.col("m")))
    return at.groupBy("label", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n_windows"), F.avg("y").alias("mean"), F.try_divide(F.stddev_samp("y"), F.sqrt(F.count("*").cast("double"))).alias("se"))


def signal_band(reads: DataFrame) -> DataFrame:
    """Per record: counts, means, medians and variation of values and their errors."""
    rel = F.try_divide(F.col("sigma"), F.abs("value"))
    return reads.groupBy("record").agg(
        F.count("*").alias("n"), F.count_if(F.col("sigma").isNull()).alias("n_sigma_unknown"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.avg("sigma").alias("mean_sigma"), F.median(rel).alias("median_relative"),
        F.try_divide(F.stddev_pop("value"), F.abs(F.avg("value"))).alias("cv"),
    )


def distinguish_band(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """Per record and rung: reads by state, and reads and purity of windows (share of confident reads)."""
    states = rows.groupBy("record", "label").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("in_spec", "in_spec_uncertain", "out_of_spec", "out_of_spec_uncertain")])
    pure = rows.filter("in_spec").groupBy("record", "label", "island").agg(F.avg(F.col("confident").cast("double")).alias("purity"), F.count("*").alias("k"))
    per = pure.groupBy("record", "label").agg(F.count("*").alias("n_windows"), F.avg("purity").alias("mean_purity"), F.median("k").alias("median_reads"))
    return states.join(per, ["record", "label"], "left")


def reliability_band(wins: DataFrame) -> DataFrame:
    """Windows by how they end, per record, rung and side."""
    return wins.groupBy("record", "label", "side").agg(*[F.count_if(F.col("death_kind") == k).alias(f"n_{k}") for k in ("crossing", "gap_start", "scan_end")], F.sum("duration_s").alias("total_s"))
