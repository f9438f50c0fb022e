"""Calibration cycles judged and compared: the battery on two clocks, a row of figures a device, and devices side by side.

The clocks: ``within_stretch`` reads each stretch of observed time for itself, its tail included; ``end_to_end`` lays all complete cycles of a device in a row, then
the last residual. Both are cells of one battery, so their checks come from one pass and the same draws. A comparison is descriptive: means to a
shared horizon, their own errors and the difference, with no test between devices, and beside each device the verdicts of its own checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators import deal, renewal, survival

LABEL, WITHIN, END_TO_END = "cycles", "within_stretch", "end_to_end"


def clock_gaps(table: DataFrame) -> DataFrame:
    """table: cycles -> gaps of both clocks (record, label, side, segment, i, x, tau), as the battery reads them."""
    x = F.when(F.col("event"), F.col("length_s"))
    stretch, record = Window.partitionBy("record", "stretch"), Window.partitionBy("record")
    time = ("start_us", "end_us")
    within = table.withColumn("tau", F.sum("length_s").over(stretch)).filter("event").select("record", F.lit(LABEL).alias("label"), F.lit(WITHIN).alias("side"), F.col("stretch").cast("long").alias("segment"), F.row_number().over(stretch.orderBy(*time)).cast("long").alias("i"), F.col("length_s").alias("x"), "tau")
    residual = F.max_by(F.when(~F.col("event"), F.col("length_s")).otherwise(0.0), F.struct(*time)).over(record)
    whole = table.withColumn("tau", F.coalesce(F.sum(x).over(record), F.lit(0.0)) + residual).filter("event").select("record", F.lit(LABEL).alias("label"), F.lit(END_TO_END).alias("side"), F.lit(0).cast("long").alias("segment"), F.row_number().over(record.orderBy(*time)).cast("long").alias("i"), F.col("length_s").alias("x"), "tau")
    return within.unionByName(whole)


def checks(table: DataFrame, n_draws: int, seed: int, groups: dict[str, tuple[str, ...]], bench_cells: int, **rule) -> DataFrame:
    """The ledger of every device and clock, the bench measured on the same cells."""
    gaps = deal.once(renewal.usable(clock_gaps(table)))
    scored, ties = deal.once(renewal.cell_tests(gaps, n_draws, seed, groups)), deal.once(renewal.tie_statistics(gaps))
    bench = renewal.bench_acceptance(renewal.bench_sizes(scored.filter("check <> grp"), ties), 0.05, bench_cells)
    cells = table.select("record", F.lit(LABEL).alias("label"), F.explode(F.array(F.lit(WITHIN), F.lit(END_TO_END))).alias("side"))
    return renewal.ledger(cells, scored, ties, tuple(m for ms in groups.values() for m in ms), bench, tuple(groups), **rule)


def means(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: pair, record, tau -> pair, record, tau, mean, se: restricted means of a device's cycles to each horizon asked."""
    curve = survival.product_limit(survival.risk_table(table.select("record", F.col("length_s").alias("age"), "event"), ["record"]), ["record"])
    out = survival.restricted_mean(curve.join(asked.withColumnRenamed("tau", "horizon"), "record"), F.col("horizon"), ["pair", "record"])
    return out.select("pair", "record", "tau", F.col("rmst").alias("mean"), F.sqrt("rmst_var").alias("se"))


def attached(ledger: DataFrame) -> DataFrame:
    """record, clock, verdicts."""
    return renewal.attachments(ledger).select("record", F.col("side").alias("clock"), F.array_join("verdicts", ",").alias("verdicts"))


def panel(table: DataFrame, live: DataFrame, dropped: DataFrame, ledger: DataFrame) -> DataFrame:
    """A row a device: cycles complete and censored, stretches and those whose first cycle was not seen to begin, mean time between calibrations to the device's largest cycle with its
    error, and the verdicts of both clocks. Devices without a cycle have their counts and nulls."""
    own = table.groupBy("record").agg(F.count_if("event").alias("n_complete"), F.count_if(~F.col("event")).alias("n_censored"), F.max("length_s").alias("top"))
    mean = means(table, own.select(F.col("record").alias("pair"), "record", F.col("top").alias("tau"))).select("record", F.col("mean").alias("mtbc_s"), F.col("se").alias("mtbc_se"))
    out = live.select("record").distinct().join(dropped, "record", "left").join(own.drop("top"), "record", "left").join(mean, "record", "left").fillna(0, ["n_complete", "n_censored"])
    verdicts = attached(ledger).groupBy("record").agg(*[F.max(F.when(F.col("clock") == clock, F.col("verdicts"))).alias(clock) for clock in (WITHIN, END_TO_END)])
    return out.join(verdicts, "record", "left")


def compare(table: DataFrame, pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """pairs: first, second (devices) -> both means to the smaller of their largest cycles, their errors, the difference, and each one's verdicts within stretches. Pairs in which a device
    has no cycle are left out: there is no shared horizon."""
    top = table.groupBy("record").agg(F.max("length_s").alias("top"))
    met = pairs.join(top.select(F.col("record").alias("first"), F.col("top").alias("a")), "first").join(top.select(F.col("record").alias("second"), F.col("top").alias("b")), "second")
    pair, tau = F.concat_ws("|", "first", "second").alias("pair"), F.least("a", "b").alias("tau")
    asked = met.select(pair, F.col("first").alias("record"), tau).union(met.select(pair, F.col("second").alias("record"), tau))
    own = means(table, asked).join(attached(ledger).filter(F.col("clock") == WITHIN), "record", "left").select("pair", "record", "mean", "se", "verdicts")
    sides = met.select("first", "second", pair, tau).join(own, "pair")
    of = lambda who, c: F.max(F.when(F.col("record") == F.col(who), F.col(c)))
    out = sides.groupBy("first", "second", "tau").agg(*[of(who, c).alias(f"{c}_{name}") for who, name in (("first", "a"), ("second", "b")) for c in ("mean", "se", "verdicts")])
    return out.withColumn("difference", F.col("mean_a") - F.col("mean_b"))
