"""Metric analyzers: gate fidelity from detuning, and lookups of declared constants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.special import bisect


def fidelity(x: Column) -> Column:
    """Average fidelity of a pi/2-like pulse at detuning x (in units of the drive): closed form."""
    lam = F.sqrt(1 + x * x)
    return (1 + 1 / (lam * lam) + x * x / (lam * lam) * F.pow(F.cos(lam * math.pi / 4), 2) + F.sin(lam * math.pi / 2) / lam) / 3


def fidelity_value(x: float) -> float:
    lam2 = 1 + x * x
    lam = math.sqrt(lam2)
    return (1 + 1 / lam2 + x * x / lam2 * math.cos(lam * math.pi / 4) ** 2 + math.sin(lam * math.pi / 2) / lam) / 3


def first_peak() -> float:
    """Where the infidelity first stops growing, to five digits: the zero of its slope, inside the step in which it first falls."""
    step, x = 1e-2, 1e-2
    fall = lambda x: fidelity_value(x + 1e-4) - fidelity_value(x - 1e-4)
    while fall(x) <= 0:
        x += step
    return round(bisect(fall, x - step, x), 5)


def detuning_threshold(infidelity: float) -> float:
    """The detuning at which the infidelity reaches a level, below its first peak."""
    top = first_peak()
    if not 0 < infidelity < 1 - fidelity_value(top):
        raise ValueError("infidelity is not reached before the first peak")
    return bisect(lambda x: 1 - fidelity_value(x) - infidelity, 0.0, top)


def infidelity_bounds(x: Column, sigma: Column, k: float = 1.0) -> tuple[Column, Column]:
    """Infidelity at |x| less and plus k sigma; null where the upper end is past the first peak."""
    low, high = F.greatest(F.abs(x) - k * sigma, F.lit(0.0)), F.abs(x) + k * sigma
    ok = high <= first_peak()
    return F.when(ok, 1 - fidelity(low)), F.when(ok, 1 - fidelity(high))


def detuning(reads: DataFrame, drive: Column) -> DataFrame:
    """Value less the record's first, over the drive."""
    w = Window.partitionBy("record").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return reads.withColumn("x", (F.col("value") - F.first("value").over(w)) / drive).withColumn("sigma_x", F.col("sigma") / F.abs(drive))


#: 2000-01-01 and 2100-01-01 in Unix seconds.
UNIX_S = (946_684_800, 4_102_444_800)


def plausible_unix_s(x: Column) -> Column:
    """Whether a number can be a time in Unix seconds of this century; false for nulls, and for milliseconds or finer."""
    return F.coalesce(x.cast("double").between(*UNIX_S), F.lit(False))


def declared_lookup(rows: DataFrame, declared: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Joins one declared number by an exact key. Keys that are absent or repeated have a reason instead of a number. Only the keys asked for are joined, so a large dimension shuffles once."""
    found = declared.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(column).alias(column))
    out = rows.join(found, keys, "left")
    return out.withColumn(column, F.when(F.col("_n") == 1, F.col(column))).withColumn("reason", F.when(F.col("_n").isNull(), "not declared").when(F.col("_n") > 1, "declared more than once").otherwise("")).drop("_n")


def guard(rows: DataFrame, column: str, cut: float) -> DataFrame:
    """Records in which every read is below a cut and known; the others are refused with a reason."""
    bad = F.count_if(~F.coalesce(F.col(column) < cut, F.lit(False)))
    return rows.groupBy("record").agg(F.count("*").alias("n"), bad.alias("n_bad")).withColumn("reason", F.when(F.col("n_bad") > 0, "a read is at or above the cut or unknown").otherwise(""))


def stage_counts(raw: DataFrame) -> DataFrame:
    """Reads per record and how many each cleaning stage drops."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return raw.groupBy("record").agg(F.count("*").alias("n_raw"), F.count_if(F.col("t_us").isNull()).alias("n_no_time"), F.count_if(F.col("t_us").isNotNull() & ~F.coalesce(ok, F.lit(False))).alias("n_not_finite"))


def clipped_fraction(rows: DataFrame, floor: float) -> DataFrame:
    return rows.groupBy("record").agg(F.avg((F.col("value") <= floor).cast("double")).alias("clipped"))


def normalised(reads: DataFrame) -> DataFrame:
    """Time from the record's first read, and the value less the record's mean."""
    w = Window.partitionBy("record")
    return reads.withColumn("t_rel_s", (F.col("t_us") - F.min("t_us").over(w)) / 1e6).withColumn("delta", F.col("value") - F.avg("value").over(w))
