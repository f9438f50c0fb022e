"""Spells of a status log and the calibration cycles between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators import deal

GAP_FACTOR = 2
CALIBRATING, OFFLINE, NOT_LISTED = "calibrating", "offline", "not listed"
US = 1_000_000.0


def by_time(*keys: str):
    return Window.partitionBy("record", *keys).orderBy("t_us")


def samples_once(samples: DataFrame) -> DataFrame:
    """One sample per time: the last row in order of sequence holds; how many rows were dropped as identical or as conflicting travels along."""
    rows = samples.groupBy("record", "t_us").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n"), F.min("status").alias("lo"), F.max("status").alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("n") - 1).otherwise(0)
    return rows.select("record", "t_us", "status", same.alias("n_identical"), (F.col("n") - 1 - same).alias("n_conflicting"))


def spells(samples: DataFrame, spacing_s: float) -> DataFrame:
    """Runs of one status without a polling gap inside: start_us, end_us (the next run's first sample, or the own last one at a gap or the end)."""
    if not spacing_s > 0:
        raise ValueError("spacing_s must be positive")
    w = by_time()
    rows = samples_once(samples).withColumn("gap", F.coalesce(F.col("t_us") - F.lag("t_us").over(w) > GAP_FACTOR * spacing_s * US, F.lit(False)))
    rows = rows.withColumn("new", F.col("gap") | F.lag("status").over(w).isNull() | (F.col("status") != F.lag("status").over(w)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_us", F.lead("t_us").over(w)).withColumn("next_gap", F.lead("gap").over(w))
    runs = rows.groupBy("record", "run", "status").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("last_us"), F.max_by(F.struct("next_us", "next_gap"), "t_us").alias("z"), F.sum("n_identical").alias("n_identical"), F.sum("n_conflicting").alias("n_conflicting"))
    cut = F.col("z.next_us").isNull() | F.col("z.next_gap")
    return runs.select("record", "run", "status", "start_us", F.when(cut, F.col("last_us")).otherwise(F.col("z.next_us")).alias("end_us"), F.coalesce("z.next_gap", F.lit(False)).alias("gap_after"), F.col("z.next_us").alias("next_us"), "n_identical", "n_conflicting")


def spell_errors(rows: DataFrame) -> DataFrame:
    """Spells that overlap the next one, run backwards or lack a status: must be empty."""
    ahead = F.lead("start_us").over(Window.partitionBy("record").orderBy("start_us", "run"))
    return rows.withColumn("ahead", ahead).filter("status is null or status = '' or end_us < start_us or ahead < end_us").drop("ahead")


def stretches(rows: DataFrame) -> DataFrame:
    """Observed stretches: the record cut at outages of positive length and at polling gaps. Spells outside outages, each with its stretch's number (from 0 among those of positive length), start and end."""
    w = Window.partitionBy("record").orderBy("run")
    outage = (F.col("status") == OFFLINE) & (F.col("end_us") > F.col("start_us"))
    marked = rows.withColumn("outage", outage).withColumn("cut", F.col("outage") | F.coalesce(F.lag("gap_after").over(w), F.lit(False)) | F.coalesce(F.lag("outage").over(w), F.lit(False)))
    marked = marked.withColumn("stretch", F.sum(F.col("cut").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    live = marked.filter("not outage").withColumn("lo_us", F.min("start_us").over(Window.partitionBy("record", "stretch"))).withColumn("hi_us", F.max("end_us").over(Window.partitionBy("record", "stretch"))).filter("hi_us > lo_us")
    number = F.dense_rank().over(Window.partitionBy("record").orderBy("lo_us")) - 1
    return live.withColumn("stretch", number.cast("long"))


def calibrations(live: DataFrame) -> DataFrame:
    """Calibrations per stretch, touching ones merged (n_merged counts them)."""
    w = Window.partitionBy("record", "stretch").orderBy("start_us", "run")
    rows = live.filter(F.col("status") == CALIBRATING).withColumn("joined", F.coalesce(F.lag("end_us").over(w) == F.col("start_us"), F.lit(False)))
    rows = rows.withColumn("c", F.sum((~F.col("joined")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("record", "stretch", "lo_us", "hi_us", "c").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count_if("joined").alias("n_merged"))


def cycles(live: DataFrame) -> DataFrame:
    """End of one calibration to the start of the next (event), the last to the stretch's end (censored)."""
    w = Window.partitionBy("record", "stretch").orderBy("start_us")
    rows = calibrations(live).withColumn("next_us", F.lead("start_us").over(w)).withColumn("first", F.row_number().over(w) == 1)
    out = rows.select("record", "stretch", "lo_us", "hi_us", F.col("end_us").alias("start_us"), F.coalesce("next_us", "hi_us").alias("end_us"), F.col("next_us").isNotNull().alias("event"), "first")
    return out.filter("event or end_us > start_us").withColumn("length_s", (F.col("end_us") - F.col("start_us")) / US)


def dropped_births(live: DataFrame) -> DataFrame:
    """Per record: stretches, those without a calibration or with time before their first one, and calibrations merged."""
    whole = live.groupBy("record", "stretch", "lo_us").agg(F.min(F.when(F.col("status") == CALIBRATING, F.col("start_us"))).alias("first_us"))
    n = whole.groupBy("record").agg(F.count("*").alias("n_stretches"), F.count_if(F.col("first_us").isNull() | (F.col("first_us") > F.col("lo_us"))).alias("n_dropped"))
    merged = calibrations(live).groupBy("record").agg(F.sum("n_merged").alias("n_merged"))
    return n.join(merged, "record", "left").withColumn("n_merged", F.coalesce("n_merged", F.lit(0)))


def cycle_events(table: DataFrame) -> DataFrame:
    """Cycles as an event table for the survival estimators."""
    return table.select("record", F.lit("cycles").alias("label"), F.lit("cycles").alias("side"), F.col("start_us").alias("birth_us"), F.col("length_s").alias("age"), "event", F.col("length_s").alias("age_lo"), F.when(F.col("event"), F.col("length_s")).otherwise(F.lit(float("inf"))).alias("age_hi"))


def battery_segments(table: DataFrame, min_events: int = 2) -> DataFrame:
    """Per stretch: complete cycles in order and tau, their sum and the censored tail; short and constant ones left out."""
    x = F.when(F.col("event"), F.col("length_s"))
    seg = table.groupBy("record", "stretch").agg(F.count(x).alias("n"), F.sum("length_s").alias("tau"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return seg.filter(f"n >= {max(2, min_events)} and hi > lo").drop("lo", "hi")


def observed_clock(table: DataFrame) -> DataFrame:
    """All complete cycles of a record end to end, then the last residual: one segment a record."""
    last = F.max_by(F.when(~F.col("event"), F.col("length_s")).otherwise(0.0), "start_us")
    x = F.when(F.col("event"), F.col("length_s"))
    return table.groupBy("record").agg(F.count(x).alias("n"), (F.coalesce(F.sum(x), F.lit(0.0)) + last).alias("tau"))


def status_shares(rows: DataFrame) -> DataFrame:
    """Seconds and share of each status, and of the time no spell covers."""
    span = rows.groupBy("record").agg(F.min("start_us").alias("r0"), F.max("end_us").alias("r1"), F.sum(F.col("end_us") - F.col("start_us")).alias("listed"))
    each = rows.groupBy("record", "status").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    rest = span.select("record", F.lit(NOT_LISTED).alias("status"), (F.col("r1") - F.col("r0") - F.col("listed")).alias("us"))
    length = (F.col("r1") - F.col("r0")).cast("double")
    return each.unionByName(rest).join(span, "record").select("record", "status", (F.col("us") / US).alias("seconds"), F.try_divide(F.col("us").cast("double"), length).alias("share"))


def cycle_context(live: DataFrame, statuses: list[str]) -> DataFrame:
    """What surrounds each cycle: its stretch, whether it opens it, the previous length, the first status inside, the share of each status. Spells never straddle a cycle's ends, so the join is on the stretch and a start inside."""
    w = Window.partitionBy("record", "stretch").orderBy("start_us")
    c = cycles(live).withColumn("cycle", F.row_number().over(Window.partitionBy("record").orderBy("start_us", "end_us")) - 1).withColumn("prev_s", F.lag("length_s").over(w)).withColumn("opens", F.row_number().over(w) == 1)
    inner = live.select("record", "stretch", F.col("start_us").alias("s"), F.col("end_us").alias("e"), "status").filter("e > s")
    cond = (c.record == inner.record) & (c.stretch == inner.stretch) & (inner.s >= c.start_us) & (inner.s < c.end_us)
    met = c.join(inner.filter(F.col("status") != CALIBRATING), cond, "left").select(c["*"], "s", "e", "status")
    key = ["record", "cycle", "stretch", "lo_us", "hi_us", "start_us", "length_s", "event", "opens", "prev_s"]
    held = F.col("e") - F.col("s")
    out = met.groupBy(*key).agg(F.coalesce(F.min_by("status", "s"), F.lit("none")).alias("status_at_start"), *[(F.coalesce(F.sum(F.when(F.col("status") == x, held)), F.lit(0)) / US / F.col("length_s")).alias(f"share_{x}") for x in statuses])
    return out.withColumn("stretch_s", (F.col("hi_us") - F.col("lo_us")) / US)


def cycle_periods(live: DataFrame, n_periods: int = 4) -> DataFrame:
    """Periods of near-equal exposure, cut at the candidate (a calibration's start or a stretch's end) nearest each target, the earlier on a tie; exposure, calibrations, cycles and rates of each."""
    if n_periods < 1:
        raise ValueError("n_periods must be at least 1")
    live = deal.once(live.select("record", "run", "status", "start_us", "end_us", "stretch", "lo_us", "hi_us"))
    ahead = F.lead("start_us").over(Window.partitionBy("record", "stretch").orderBy("start_us"))
    cal = calibrations(live).select("record", "stretch", "lo_us", "hi_us", "start_us", "end_us", ahead.alias("next_us"), F.lit(True).alias("calibrated"))
    rows = live.select("record", "stretch", "lo_us", "hi_us").distinct().unionByName(cal, allowMissingColumns=True)
    # a row a stretch and one a calibration; time runs on through the stretches of a record
    own, calibrated, named = Window.partitionBy("record").orderBy("stretch"), F.col("calibrated").isNotNull(), F.col("record").isNotNull()
    length, total = F.when(~calibrated, F.col("hi_us") - F.col("lo_us")).otherwise(0), F.col("total")
    rows = rows.withColumn("off", F.coalesce(F.sum(length).over(own.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(length).over(own.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("x", F.col("off") + F.when(calibrated, F.col("start_us") - F.col("lo_us")).otherwise(0)).withColumn("y", F.col("off") + F.col("end_us") - F.col("lo_us"))
    near = lambda x, k: F.struct(F.abs(x * n_periods - total * k).alias("gap"), x.alias("x"))
    cuts = [F.least(F.min(F.when(F.col("x").isNotNull(), near(F.col("x"), k))).over(Window.partitionBy("record")), near(total, k))["x"] for k in range(1, n_periods)]
    ends = F.lit(0).cast("long"), total
    rows = rows.withColumn("bounds", F.when(named, F.array(ends[0], *cuts, ends[1])).otherwise(F.array(*ends)))  # reads of no record are one period

    def period(x: str) -> Column:
        return F.size(F.filter(F.slice("bounds", 2, n_periods - 1), lambda c: c <= F.col(x)))

    # a record's first stretch stands for all of its periods, a calibration for the period it starts in and for that in which its cycle does
    mark = lambda p, what: F.struct(p.alias("period"), F.lit(what).alias("what"))
    cycle = F.when(F.col("next_us").isNotNull(), F.array(mark(period("y"), "complete"))).when(F.col("hi_us") > F.col("end_us"), F.array(mark(period("y"), "censored"))).otherwise(F.array().cast("array<struct<period:int,what:string>>"))
    marks = F.when(calibrated & named, F.concat(F.array(mark(period("x"), "calibration")), cycle)).when(~calibrated & (F.col("off") == 0), F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda k: mark(k, "period")))
    each = rows.select("record", "bounds", F.inline(marks)).groupBy("record", F.col("period").cast("long").alias("period"), "bounds")
    out = each.agg(*[F.count_if(F.col("what") == w).alias(n) for w, n in (("calibration", "n_calibrations"), ("complete", "n_complete"), ("censored", "n_censored"))])
    out = out.withColumn("from", F.get("bounds", F.col("period").cast("int"))).withColumn("to", F.get("bounds", F.col("period").cast("int") + 1))
    hours = (F.col("to") - F.col("from")) / (3600 * US)
    return out.select("record", "period", hours.alias("exposure_h"), "n_calibrations", "n_complete", "n_censored", F.try_divide(F.col("n_calibrations").cast("double"), hours).alias("calibrations_per_h"))
