"""Survival estimators on right-censored durations: risk tables, product-limit curves, hazards, restricted means, comparisons, pooling.

An event table has a key (any columns), ``age`` (double), ``event`` (boolean) and, for placement brackets, ``age_lo`` and ``age_hi``.
Ages are grouped before any window runs. Curves of many keys (records) take a window a key; curves of few and large keys (``pooled``) run in
pieces, see ``prefix``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.special import normal_quantile
from tidespan.operators.prefix import piece, running

ROOT_EPS = math.sqrt(2.0**-52)
CELL = ("record", "label", "side")


def event_table(wins: DataFrame) -> DataFrame:
    """Windows whose birth was seen, as durations with an event flag and the interval their true length lies in."""
    us = 1_000_000.0
    lo = (F.col("last_us") - F.col("birth_us")) / us
    hi = F.when(F.col("censored"), F.lit(float("inf"))).otherwise((F.col("death_us") - F.col("prev_us")) / us)
    return wins.filter("birth_seen").select("record", "label", "side", "birth_us", F.col("duration_s").alias("age"), (~F.col("censored")).alias("event"), lo.alias("age_lo"), hi.alias("age_hi"))


def unseen_births(wins: DataFrame, key: Sequence[str] = CELL) -> DataFrame:
    return wins.groupBy(*key).agg(F.count_if(~F.col("birth_seen")).alias("n_unseen"))


def event_table_errors(events: DataFrame) -> DataFrame:
    """Rows that no event table may hold: ages null, negative or not finite, events null, an interval that does not hold the age."""
    bad = F.col("age").isNull() | F.col("event").isNull() | F.isnan("age") | (F.col("age") < 0) | (F.col("age") == float("inf")) | (F.col("age_lo") > F.col("age")) | (F.col("age_hi") < F.col("age"))
    return events.filter(F.coalesce(bad, F.lit(False)))


def risk_table(events: DataFrame, key: Sequence[str] = CELL, pooled: bool = False) -> DataFrame:
    """Per distinct age: deaths, censorings, the number at risk (ages of this and above) and the next age. ``pooled``, here and below: keys are few and large."""
    ages = events.groupBy(*key, "age").agg(F.count_if("event").alias("deaths"), F.count_if(~F.col("event")).alias("censorings"))
    return running(ages, key, "age", {"at_risk": (F.col("deaths") + F.col("censorings"), "sum"), "next_age": (F.col("age"), "nearest")}, down=True, pooled=pooled)


def product_limit(risk: DataFrame, key: Sequence[str] = CELL, pooled: bool = False) -> DataFrame:
    """Survival after each age and Greenwood's sum (infinite once the risk set is consumed), with the cumulative hazard and its variance."""
    d, n = F.col("deaths"), F.col("at_risk")
    term = F.when(d == 0, 0.0).when(d == n, F.lit(float("inf"))).otherwise(d / (n.cast("double") * (n - d)))
    return running(risk, key, "age", {"survival": (1 - d / n, "product"), "greenwood": (term, "sum"), "hazard": (d / n, "sum"), "hazard_var": (d / (n * n), "sum")}, pooled=pooled)


def loglog_band(curve: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds lower and upper of the log-log band; null where survival is 0 or 1."""
    z = normal_quantile((1 + level) / 2)
    s = F.col("survival")
    open_ = (s > 0) & (s < 1)
    width = F.when(open_, z * F.sqrt("greenwood") / F.abs(F.ln(F.when(open_, s))))
    return curve.withColumn("lower", F.pow(s, F.exp(width))).withColumn("upper", F.pow(s, F.exp(-width)))


def hazard_band(curve: DataFrame, level: float = 0.95) -> DataFrame:
    z = normal_quantile((1 + level) / 2)
    h = F.col("hazard")
    width = F.when(h > 0, z * F.sqrt("hazard_var") / h)
    return curve.withColumn("hazard_lower", h * F.exp(-width)).withColumn("hazard_upper", h * F.exp(width))


def survival_quantile(curve: DataFrame, p: float, column: str = "survival", key: Sequence[str] = CELL, pooled: bool = False) -> DataFrame:
    """First age with survival at or below 1 - p; an exact hit takes the midpoint to the next drop, or to the largest age."""
    s, level = F.col(column), 1 - p
    drop = (F.col("deaths") > 0) & s.isNotNull()
    steps = running(curve, key, "age", {"after": (F.when(drop, F.col("age")), "nearest")}, down=True, pooled=pooled)
    hit = steps.groupBy(*key).agg(F.max("age").alias("top"), F.min_by(F.struct("age", "after", s.alias("s")), F.when(drop & (s <= level + ROOT_EPS), F.col("age"))).alias("m")).filter("m is not null")
    return hit.select(*key, F.when(F.abs(F.col("m.s") - level) <= ROOT_EPS, (F.col("m.age") + F.coalesce(F.col("m.after"), F.col("top"))) / 2).otherwise(F.col("m.age")).alias("quantile"))


def restricted_mean(curve: DataFrame, tau: Column | float, key: Sequence[str] = CELL, pooled: bool = False) -> DataFrame:
    """curve: of ``product_limit``. Area under it up to tau and its variance, the sum over deaths before tau of (area beyond)^2 d / (n (n - d))."""
    tau = F.lit(tau) if isinstance(tau, (int, float)) else tau
    to = F.least(F.coalesce("next_age", "tau"), F.col("tau"))
    rows = curve.withColumn("tau", tau).withColumn("area", F.greatest(F.lit(0.0), to - F.least("age", "tau")) * F.col("survival")).withColumn("_piece", piece("age") if pooled else F.lit(0))
    d, n = F.col("deaths"), F.col("at_risk").cast("double")
    part = F.when((d > 0) & (n > d) & (F.col("age") < F.col("tau")), d / (n * F.nullif(n - d, F.lit(0.0)))).otherwise(0.0)  # once all have died nothing lies beyond
    here = Window.partitionBy(*key, "_piece").orderBy(F.col("age").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_l", F.sum("area").over(here)).withColumn("_g", part)
    # (later pieces + this one's rest)^2 opened up, so that a piece's sums are all that is needed of it
    sums = rows.groupBy(*key, "_piece").agg(F.sum("area").alias("_a"), F.min("age").alias("_least"), F.first("tau").alias("tau"), F.sum("_g").alias("_g0"), F.sum(F.col("_g") * F.col("_l")).alias("_g1"), F.sum(F.col("_g") * F.col("_l") * F.col("_l")).alias("_g2"))
    later = F.coalesce(F.sum("_a").over(Window.partitionBy(*key).orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("_b", later)
    var = F.col("_b") * F.col("_b") * F.col("_g0") + 2 * F.col("_b") * F.col("_g1") + F.col("_g2")
    return sums.groupBy(*key).agg((F.sum("_a") + F.least(F.min("_least"), F.first("tau"))).alias("rmst"), F.sum(var).alias("rmst_var"), F.first("tau").alias("tau"))


def with_largest_age(curve: DataFrame, key: Sequence[str] = CELL) -> DataFrame:
    return curve.withColumn("largest", F.max("age").over(Window.partitionBy(*key)))


def placement_bracket(events: DataFrame, tau: float, key: Sequence[str] = CELL) -> DataFrame:
    """Restricted areas of the lower and upper curves that the length intervals allow, and the width between them."""
    lower = F.avg(F.least(F.col("age_lo"), F.lit(tau)))
    upper = F.avg(F.when(F.col("event"), F.least(F.col("age_hi"), F.lit(tau))).otherwise(tau))
    return events.groupBy(*key).agg(F.count("*").alias("n"), lower.alias("lower_area"), upper.alias("upper_area"), (upper - lower).alias("width"))


def _half(events: DataFrame, value: Column, key: Sequence[str], name: str) -> DataFrame:
    """Where a curve that falls at each value by 1/n comes to one half: halfway to the next value if it stays there; null where it does not fall below. Null values never make it fall."""
    w = Window.partitionBy(*key).orderBy(F.col("v").asc_nulls_last())
    rows = events.groupBy(*key, value.alias("v")).agg(F.count("*").alias("c"))
    rows = rows.select(*key, "v", F.lead("v").over(w).alias("next"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("c").over(Window.partitionBy(*key)).alias("n"))
    first = rows.filter("2 * cum >= n").groupBy(*key).agg(F.min_by(F.struct("v", "next", (F.col("cum") * 2 == F.col("n")).alias("flat")), "cum").alias("s"))
    return first.select(*key, F.when(F.col("s.flat"), (F.col("s.v") + F.col("s.next")) / 2).otherwise(F.col("s.v")).alias(name))


def bracket_medians(events: DataFrame, tau: float, key: Sequence[str] = CELL) -> DataFrame:
    """Medians of the lower and upper curves that the length intervals allow, and the width of the areas that censoring alone leaves."""
    age = F.least(F.col("age"), F.lit(tau))
    width = events.groupBy(*key).agg(F.avg(F.when(F.col("event"), age).otherwise(tau)).alias("_up"), F.avg(age).alias("_lo"))
    out = width.select(*key, (F.col("_up") - F.col("_lo")).alias("width_censoring"))
    return out.join(_half(events, F.col("age_lo"), key, "median_lower"), list(key)).join(_half(events, F.when(F.col("event"), F.col("age_hi")), key, "median_upper"), list(key))


def step_at(curve: DataFrame, at: DataFrame, key: Sequence[str] = CELL) -> DataFrame:
    """Right-continuous value of the curve at given ages (key, at): union and forward fill, no join."""
    both = curve.select(*key, F.col("age").alias("x"), "survival", F.lit(0).alias("asked")).unionByName(at.select(*key, F.col("at").alias("x"), F.lit(None).cast("double").alias("survival"), F.lit(1).alias("asked")))
    filled = both.withColumn("s", F.coalesce(F.last("survival", ignorenulls=True).over(Window.partitionBy(*key).orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    return filled.filter("asked = 1").select(*key, F.col("x").alias("at"), F.col("s").alias("survival"))


def log_time_separation(curves: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """All pairs of curves within a key: the integral of |S_a - S_b| over log10 of age, ranked widest first.

    Curves are few (labels or groups, not records); each pair walks the union of its own steps.
    """
    steps = curves.filter("age > 0").select(*key, F.col(name).alias("c"), "age", "survival")
    names = steps.select(*key, "c").distinct()
    pairs = names.withColumnRenamed("c", "a").join(names.withColumnRenamed("c", "b"), list(key)).filter("a < b")
    one = pairs.join(steps.withColumnRenamed("c", "a"), [*key, "a"]).select(*key, "a", "b", "age", F.col("survival").alias("sa"), F.lit(None).cast("double").alias("sb"))
    two = pairs.join(steps.withColumnRenamed("c", "b"), [*key, "b"]).select(*key, "a", "b", "age", F.lit(None).cast("double").alias("sa"), F.col("survival").alias("sb"))
    grid = one.unionByName(two).groupBy(*key, "a", "b", "age").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    w = Window.partitionBy(*key, "a", "b").orderBy("age")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fill = grid.withColumn("fa", F.coalesce(F.last("sa", True).over(back), F.lit(1.0))).withColumn("fb", F.coalesce(F.last("sb", True).over(back), F.lit(1.0))).withColumn("to", F.lead("age").over(w))
    out = fill.groupBy(*key, "a", "b").agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.log10("to") - F.log10("age"))).alias("separation"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("separation").desc_nulls_last(), "a", "b"))
    return out.withColumn("rank", rank.cast("long"))


def log_rank(events: DataFrame, group: str, first: str, second: str, key: Sequence[str]) -> DataFrame:
    """(O - E) / sqrt(V) of ``first`` against ``second``; null with a reason where undefined. One pass over pooled ages, no join."""
    a = F.col(group) == first
    ages = events.filter(F.col(group).isin(first, second)).groupBy(*key, "age").agg(
        F.count_if(a).alias("ca"), F.count_if(~a).alias("cb"), F.count_if(a & F.col("event")).alias("da"), F.count_if(~a & F.col("event")).alias("db")
    )
    r = running(ages, key, "age", {"na": (F.col("ca").cast("double"), "sum"), "nb": (F.col("cb").cast("double"), "sum")}, down=True).filter("da + db > 0")
    d, n = F.col("da") + F.col("db"), F.col("na") + F.col("nb")
    v = F.when(n > 1, F.col("na") * F.col("nb") * d * (n - d) / (n * n * F.nullif(n - 1, F.lit(0.0)))).otherwise(0.0)
    out = r.groupBy(*key).agg(F.sum(F.col("da") - d * F.col("na") / n).alias("o_minus_e"), F.sum(v).alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, F.col("o_minus_e") / F.sqrt("variance"))).withColumn("reason", F.when(F.col("variance") > 0, "").otherwise("zero variance"))


def comparison_tau(events: DataFrame, record: str, key: Sequence[str]) -> DataFrame:
    """Smallest of the records' largest ages, and the first record that attains it."""
    top = events.groupBy(*key, record).agg(F.max("age").alias("top"))
    return top.groupBy(*key).agg(F.min("top").alias("tau"), F.min_by(record, F.struct("top", record)).alias("tau_record"), F.count("*").alias("n_records"))


def pool_random_effects(means: DataFrame, key: Sequence[str]) -> DataFrame:
    """DerSimonian-Laird pooling of (mean, var) rows: Q, C, tau^2, I^2, the pooled mean and its standard error. Three records or more with a variance."""
    w = 1 / F.col("var")
    good = means.filter("var > 0")
    s = good.groupBy(*key).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * F.col("mean")).alias("swy")).filter("k >= 3")
    fixed = good.join(s, list(key)).withColumn("dev", w * F.pow(F.col("mean") - F.col("swy") / F.col("sw"), 2))
    q = fixed.groupBy(*key).agg(F.first("k").alias("k"), F.sum("dev").alias("q"), (F.first("sw") - F.first("sww") / F.first("sw")).alias("c"))
    q = q.withColumn("tau2", F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / F.col("c")))
    u = 1 / (F.col("var") + F.col("tau2"))
    pooled = good.join(q, list(key)).groupBy(*key).agg(*[F.first(x).alias(x) for x in ("k", "q", "c", "tau2")], (F.sum(u * F.col("mean")) / F.sum(u)).alias("pooled"), F.sqrt(1 / F.sum(u)).alias("se"))
    return pooled.withColumn("i2", F.col("tau2") / F.nullif(F.col("tau2") + (F.col("k") - 1) / F.col("c"), F.lit(0.0)))


def inter_event(events: DataFrame, key: Sequence[str], time: str = "t_us", seq: str = "seq") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(time, seq)
    return events.withColumn("interval_s", (F.col(time) - F.lag(time).over(w)) / 1e6)


def interval_stats(intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    x = F.col("interval_s")
    return intervals.groupBy(*key).agg(F.count(x).alias("n"), F.avg(x).alias("mean_s"), F.stddev_pop(x).alias("std_s"), F.min(x).alias("min_s"), F.max(x).alias("max_s"))


def log_histogram(intervals: DataFrame, bins: int = 50) -> DataFrame:
    """Counts over equal bins of log10 between the least and the largest positive interval, the last bin closed; with the number dropped."""
    edges = intervals.agg(F.min(F.when(F.col("interval_s") > 0, F.log10("interval_s"))).alias("lo"), F.max(F.when(F.col("interval_s") > 0, F.log10("interval_s"))).alias("hi"), F.count_if(F.col("interval_s") <= 0).alias("dropped"))
    x = intervals.filter("interval_s > 0").crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.log10("interval_s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)).cast("long"))
    return x.groupBy("bin", "dropped").agg(F.count("*").alias("n"))


def linear_histogram(values: DataFrame, column: str, key: Sequence[str], bins: int = 40) -> DataFrame:
    w = Window.partitionBy(*key)
    x = values.filter(F.col(column).isNotNull()).withColumn("lo", F.min(column).over(w)).withColumn("hi", F.max(column).over(w)).filter("hi > lo")
    return x.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")).groupBy(*key, "bin").agg(F.count("*").alias("n"))


def view_limit(hist: DataFrame, key: Sequence[str], share: float = 0.99) -> DataFrame:
    """First bin by which ``share`` of the mass is reached, and the count beyond it."""
    w = Window.partitionBy(*key)
    run = hist.withColumn("seen", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return run.filter(F.col("seen") >= share * F.col("total")).groupBy(*key).agg(F.min("bin").alias("limit_bin"), (F.min("total") - F.min("seen")).alias("n_beyond"))


def binned_intervals(intervals: DataFrame, day: Column, days: int = 14) -> DataFrame:
    """Quartiles and the 90th percentile of intervals in bins of ``days``, empty bins included as nulls, the final bin closed."""
    x = intervals.filter("interval_s is not null").withColumn("day", day)
    span = x.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    top = F.greatest(F.lit(0), F.ceil((F.col("d1") - F.col("d0")) / days).cast("long") - 1)
    placed = x.crossJoin(F.broadcast(span)).withColumn("bin", F.least(top, F.floor((F.col("day") - F.col("d0")) / days).cast("long")))
    q = placed.groupBy("bin").agg(F.count("*").alias("n"), *[F.percentile("interval_s", F.lit(p)).alias(c) for p, c in ((0.25, "q1_s"), (0.5, "median_s"), (0.75, "q3_s"), (0.9, "p90_s"))])
    spine = span.select(F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("bin"))
    return spine.join(q, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def variation(values: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    return values.groupBy(*key).agg(F.try_divide(F.stddev_pop(column), F.abs(F.avg(column))).alias("cv"))
