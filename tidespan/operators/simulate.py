"""Simulated renewal processes and the rejection rates of the checks on them.

Arms: a (independent Weibull gaps), d (a power-law change of time: trend), e (Gaussian-copula AR(1) dependence), e2 (second-order moving
average), el (a level shift), b and c (independent or AR(1) reads cut at a quantile by the engine's own rule). A cell of the design is a
seed, so cells are generated where they are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.operators import renewal


def weibull(u: np.ndarray, shape: float) -> np.ndarray:
    """Unit-mean Weibull gaps from uniforms."""
    return (-np.log1p(-u)) ** (1 / shape) / math.gamma(1 + 1 / shape)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in z])


def runs_above(x: np.ndarray, q: float) -> np.ndarray:
    """Lengths of complete runs at or above a quantile: both ends seen."""
    on = x >= np.quantile(x, q)
    edge = np.flatnonzero(np.diff(on.astype(int)))
    if len(edge) < 2:
        return np.empty(0)
    starts, ends = edge[:-1] + 1, edge[1:] + 1
    keep = on[starts]
    return (ends - starts)[keep].astype(float)


def arm(name: str, n: int, rng: np.random.Generator, shape: float = 1.5, strength: float = 0.3) -> np.ndarray:
    """n gaps of one arm (b and c: as many as the reads give)."""
    if name == "a":
        return weibull(rng.random(n), shape)
    if name == "d":
        t = np.cumsum(weibull(rng.random(n), shape)) ** (1 / (1 + strength))
        return np.diff(np.concatenate([[0.0], t]))
    if name in ("e", "e2"):
        z = rng.standard_normal(n + 2)
        if name == "e":
            for i in range(1, n + 2):
                z[i] = strength * z[i - 1] + math.sqrt(1 - strength**2) * z[i]
            z = z[2:]
        else:
            z = (z[2:] + strength * z[:-2]) / math.sqrt(1 + strength**2)
        return weibull(np.clip(_normal_cdf(z), 1e-12, 1 - 1e-12), shape)
    if name == "el":
        x = weibull(rng.random(n), shape)
        x[n // 2 :] *= 1 + strength
        return x
    if name in ("b", "c"):
        z = rng.standard_normal(6 * n)
        if name == "c":
            for i in range(1, len(z)):
                z[i] = strength * z[i - 1] + math.sqrt(1 - strength**2) * z[i]
        return runs_above(z, 0.5)[:n]
    raise ValueError(f"unknown arm {name!r}")


def quantise(x: np.ndarray, step: float) -> np.ndarray:
    return np.maximum(np.ceil(x / step), 1) * step


def design(arms: tuple[str, ...] = ("a", "d", "e", "e2", "el"), sizes: tuple[int, ...] = (20, 50, 100), shapes: tuple[float, ...] = (0.75, 1.5), replicates: int = 100) -> list[tuple[str, int, float, int]]:
    return [(a, n, s, r) for a in arms for n in sizes for s in shapes for r in range(replicates)]


def gaps(spark: SparkSession, cells: list[tuple[str, int, float, int]], seed: int = 1) -> DataFrame:
    """The gaps of all cells in the form the checks read: the cell's number is the record, its arm, size and shape the label."""
    frame = spark.createDataFrame([(i, a, n, s) for i, (a, n, s, _) in enumerate(cells)], "id long, arm string, n int, shape double")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.itertuples():
                rng = np.random.default_rng([seed, row.id])
                x = arm(row.arm, row.n, rng, row.shape)
                tau = x.sum() + rng.random() * x.mean()
                parts.append(pd.DataFrame({"record": row.id, "label": f"{row.arm}|{row.n}|{row.shape}", "side": "sim", "segment": 0, "i": np.arange(1, len(x) + 1), "x": x, "tau": tau, "n": len(x)}))
            if parts:
                yield pd.concat(parts)

    return frame.repartition("id").mapInPandas(draw, "record long, label string, side string, segment long, i long, x double, tau double, n long")


def rejection_rates(spark: SparkSession, cells: list[tuple[str, int, float, int]], n_draws: int = 99, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Share of replicates each check rejects, with its Monte Carlo error, per arm, size and shape."""
    scored = renewal.battery_p_values(renewal.battery(gaps(spark, cells, seed), n_draws, seed))
    rate = F.avg((F.col("p") <= alpha).cast("double"))
    return scored.groupBy("label", F.col("check").alias("check_name")).agg(F.count("*").alias("replicates"), F.round(rate, 6).alias("rate"), F.round(F.sqrt(rate * (1 - rate) / F.count("*")), 6).alias("mc_se"))


def promotion(rates: DataFrame, alpha: float = 0.05, z: float = 3.0) -> DataFrame:
    """promote if the null arm's rate lies within z errors of alpha, else hold (above) or reject (far above)."""
    null = rates.filter(F.col("label").startswith("a|"))
    err = F.sqrt(F.lit(alpha * (1 - alpha)) / F.col("replicates"))
    worst = F.max(F.abs(F.col("rate") - alpha) / err)
    return null.groupBy("check_name").agg(worst.alias("worst_z"), F.count("*").alias("n_cells")).withColumn("decision", F.when(F.col("worst_z") <= z, "promote").when(F.col("worst_z") <= 2 * z, "hold").otherwise("reject"))
