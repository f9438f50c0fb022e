"""From reads to windows: gaps, segments, and maximal runs on one side of a threshold.

A record is a partition: every window function here partitions by ``record``, so one exchange feeds the whole chain, whatever the
number of thresholds. Times are integer microseconds, so equal times are equal in every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IN, OUT = "in_spec", "out_of_spec"
US = 1_000_000.0


@dataclass(frozen=True)
class Rung:
    """One threshold of a ladder."""

    label: str
    value: float
    big_is_good: bool = True


def ladder_frame(spark: SparkSession, ladder: list[Rung]) -> DataFrame:
    if len({r.label for r in ladder}) != len(ladder):
        raise ValueError("threshold labels repeat")
    return spark.createDataFrame([(r.label, float(r.value), r.big_is_good) for r in ladder], "label string, threshold double, big_is_good boolean")


def in_time(*keys: str):
    """The reads of a record in order of time, ties by sequence."""
    return Window.partitionBy("record", *keys).orderBy("t_us", "seq")


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def observed_reads(reads: DataFrame, gap_mult: float = 10.0) -> DataFrame:
    """Reads (record, t_us, seq, value, sigma) without non-finite ones, with dt_us, gap_us, is_gap, segment and n.

    Reads are dropped before spacing is measured. A gap is a step longer than ``gap_mult`` medians of the positive steps; a record
    with fewer than two distinct times has no spacing and no gap.
    """
    if not gap_mult > 0:
        raise ValueError("gap_mult must be positive")
    clean = reads.filter(F.col("t_us").isNotNull() & finite("value")).withColumn("sigma", F.when(finite("sigma"), F.col("sigma")))
    step = clean.withColumn("dt_us", F.col("t_us") - F.lag("t_us").over(in_time()))
    whole = Window.partitionBy("record")
    gap = step.withColumn("gap_us", gap_mult * F.median(F.when(F.col("dt_us") > 0, F.col("dt_us"))).over(whole)).withColumn("n", F.count("*").over(whole))
    flagged = gap.withColumn("is_gap", F.coalesce(F.col("dt_us") > F.col("gap_us"), F.lit(False)))
    return flagged.withColumn("segment", F.sum(F.col("is_gap").cast("long")).over(in_time().rowsBetween(Window.unboundedPreceding, 0)))


def gap_stats(obs: DataFrame) -> DataFrame:
    """Per record: reads, gaps, repeated times, median spacing, gap threshold and the effective spacing (sum of squares over sum, within segments)."""
    inside = F.when(~F.col("is_gap"), F.col("dt_us") / US)
    return obs.groupBy("record").agg(
        F.count("*").alias("n_reads"), F.count_if("is_gap").alias("n_gaps"), F.count_if(F.col("dt_us") <= 0).alias("n_repeated"), F.median(F.when(F.col("dt_us") > 0, F.col("dt_us") / US)).alias("median_spacing_s"),
        (F.max("gap_us") / US).alias("gap_threshold_s"), F.try_divide(F.sum(inside * inside), F.sum(inside)).alias("effective_spacing_s"), F.try_divide(F.stddev_pop(inside), F.avg(inside)).alias("spacing_cv"),
    )


def segments(obs: DataFrame) -> DataFrame:
    """Maximal runs of reads without a gap inside."""
    return obs.groupBy("record", "segment").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n_reads"))


def gap_spans(obs: DataFrame) -> DataFrame:
    return obs.filter("is_gap").select("record", (F.col("t_us") - F.col("dt_us")).alias("before_us"), F.col("t_us").alias("after_us"))


def margin(value: Column, threshold: Column, big_is_good: Column) -> Column:
    return F.when(big_is_good, value - threshold).otherwise(threshold - value)


def is_in_spec(m: Column) -> Column:
    """The one definition: equality is in spec, in both directions."""
    return m >= 0


def is_confident(m: Column, sigma: Column, k: float) -> Column:
    """Sigma known and the margin at least k of them."""
    return F.coalesce(F.abs(m) >= k * sigma, F.lit(False))


def threshold_reads(obs: DataFrame, ladder: DataFrame, k: float = 1.0) -> DataFrame:
    """A row per read and rung, with margin, in_spec, confident, state and the number of its window (``island``).

    The ladder is broadcast: it is a literal of the caller. Records with fewer than two reads have no windows.
    """
    if not k > 0:
        raise ValueError("k must be positive")
    rows = obs.filter("n >= 2").crossJoin(F.broadcast(ladder)).withColumn("margin", margin(F.col("value"), F.col("threshold"), F.col("big_is_good")))
    rows = rows.withColumn("in_spec", is_in_spec(F.col("margin"))).withColumn("confident", is_confident(F.col("margin"), F.col("sigma"), k))
    rows = rows.withColumn("state", F.concat(F.when(F.col("in_spec"), IN).otherwise(OUT), F.when(F.col("confident"), "").otherwise("_uncertain")))
    w = in_time("label")
    rows = rows.withColumn("prev_us", F.lag("t_us").over(w)).withColumn("prev_in", F.lag("in_spec").over(w)).withColumn("next_us", F.lead("t_us").over(w)).withColumn("next_gap", F.lead("is_gap").over(w)).withColumn("rn", F.row_number().over(w))
    starts = F.col("prev_in").isNull() | F.col("is_gap") | (F.col("in_spec") != F.col("prev_in"))
    return rows.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def windows(rows: DataFrame) -> DataFrame:
    """One row per maximal run of one side. A gap beats a crossing on either end; a window cut by a gap or the end of the record is censored and ends at its last read."""
    runs = rows.groupBy("record", "label", "island", "in_spec").agg(
        F.min("t_us").alias("birth_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n_reads"), F.min("margin").alias("min_margin"),
        F.min_by(F.struct("prev_us", "is_gap"), "rn").alias("a"), F.max_by(F.struct("next_us", "next_gap"), "rn").alias("z"), F.any_value("threshold").alias("threshold"), F.any_value("segment").alias("segment"),
    )
    birth = F.when(F.col("a.prev_us").isNull(), "scan_start").when(F.col("a.is_gap"), "gap_resume").otherwise("crossing")
    death = F.when(F.col("z.next_us").isNull(), "scan_end").when(F.col("z.next_gap"), "gap_start").otherwise("crossing")
    out = runs.withColumn("birth_kind", birth).withColumn("death_kind", death).withColumn("side", F.when(F.col("in_spec"), IN).otherwise(OUT))
    out = out.withColumn("birth_seen", F.col("birth_kind") == "crossing").withColumn("censored", F.col("death_kind") != "crossing")
    out = out.withColumn("death_us", F.when(F.col("censored"), F.col("last_us")).otherwise(F.col("z.next_us"))).withColumn("prev_us", F.when(F.col("birth_seen"), F.col("a.prev_us")))
    return out.withColumn("duration_s", (F.col("death_us") - F.col("birth_us")) / US).drop("a", "z", "in_spec")


def read_table(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """Reads with the age of their window and the time left in it (in-spec windows only, nulls elsewhere)."""
    side = wins.filter(F.col("side") == IN).select("record", "label", "island", "birth_us", "death_us")
    met = rows.join(side, ["record", "label", "island"], "left")
    return met.withColumn("age_s", (F.col("t_us") - F.col("birth_us")) / US).withColumn("left_s", (F.col("death_us") - F.col("t_us")) / US)


def tiling_errors(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """(record, label) whose windows do not account for the observed time: must be empty."""
    held = rows.groupBy("record", "label").agg(F.sum(F.when(~F.col("is_gap"), F.col("dt_us"))).alias("observed_us"))
    tiled = wins.groupBy("record", "label").agg(F.sum(F.col("death_us") - F.col("birth_us")).alias("tiled_us"))
    return held.join(tiled, ["record", "label"], "full").filter("not (coalesce(observed_us, 0) <=> coalesce(tiled_us, 0))")


def held_intervals(rows: DataFrame) -> DataFrame:
    """Each observed step, held by its left read: adds held_us, the step to the next read inside the segment (0 at a gap or the end)."""
    return rows.withColumn("held_us", F.when(F.coalesce(F.col("next_gap"), F.lit(True)), 0).otherwise(F.col("next_us") - F.col("t_us")))


def occupancy(rows: DataFrame) -> DataFrame:
    """Share of observed time in spec; null where no time was observed."""
    h = held_intervals(rows)
    return h.groupBy("record", "label").agg(F.count("*").alias("n_reads"), (F.sum("held_us") / US).alias("observed_s"), F.try_divide(F.sum(F.when(F.col("in_spec"), F.col("held_us")).otherwise(0)).cast("double"), F.sum("held_us").cast("double")).alias("occupancy"))


def cumulative_out(rows: DataFrame) -> DataFrame:
    """Running time out of spec at each read (left Riemann)."""
    h = held_intervals(rows).withColumn("inc", F.when(F.col("in_spec"), 0).otherwise(F.col("held_us")))
    return h.withColumn("out_s", F.coalesce(F.sum("inc").over(in_time("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / US)


def cumulative_damage(rows: DataFrame, damage=lambda c: c) -> DataFrame:
    """Running trapezoid of the excess beyond the threshold, through a damage function from Column to Column."""
    w = in_time("label")
    rate = rows.withColumn("rate", damage(F.greatest(-F.col("margin"), F.lit(0.0))))
    step = F.when(F.col("is_gap") | F.col("dt_us").isNull(), 0.0).otherwise(0.5 * (F.lag("rate").over(w) + F.col("rate")) * F.col("dt_us") / US)
    return rate.withColumn("step", step).withColumn("damage", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def time_to_first_failure(rows: DataFrame) -> DataFrame:
    first = F.min(F.when(~F.col("in_spec"), F.col("t_us")))
    return rows.groupBy("record", "label").agg(((first - F.min("t_us")) / US).alias("ttf_s"))


def timeline(rows: DataFrame, column: str) -> DataFrame:
    """Contiguous runs of one value of ``column`` inside segments."""
    w = in_time("label")
    new = F.lag(column).over(w).isNull() | F.col("is_gap") | (F.col(column) != F.lag(column).over(w))
    runs = rows.withColumn("run", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("record", "label", "run", column).agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n_reads"))


def split_at_gaps(spans: DataFrame, gaps: DataFrame, value: str) -> DataFrame:
    """Timeline rows with the parts inside observation gaps replaced by ``unobserved``.

    Both sides of the overlap join are keyed by record; pieces come from the sorted cut points, so nothing is multiplied by pairs of gaps.
    """
    cuts = spans.select("record", "label", F.col("start_us").alias("at")).union(spans.select("record", "label", "end_us"))
    edges = gaps.join(spans.select("record", "label").distinct(), "record")
    cuts = cuts.union(edges.select("record", "label", "before_us")).union(edges.select("record", "label", "after_us")).distinct()
    pieces = cuts.withColumn("to", F.lead("at").over(Window.partitionBy("record", "label").orderBy("at"))).filter("to is not null")
    inside = pieces.join(spans.select("record", "label", "start_us", "end_us", F.col(value).alias("v")), ["record", "label"]).filter("at >= start_us and to <= end_us and start_us < end_us")
    lost = gaps.withColumnRenamed("before_us", "g0").withColumnRenamed("after_us", "g1")
    flagged = inside.join(lost, (inside.record == lost.record) & (inside["at"] >= lost.g0) & (inside["to"] <= lost.g1), "left").select(inside.record, "label", F.col("at").alias("start_us"), F.col("to").alias("end_us"), F.when(F.col("g0").isNotNull(), "unobserved").otherwise(F.col("v")).alias(value))
    return flagged.distinct()


def in_spec_bounds(rows: DataFrame) -> DataFrame:
    """Lower and upper bounds of the in-spec share: steps with a crossing or an unsure left read count for neither or for both."""
    w = in_time("label")
    h = held_intervals(rows).withColumn("unsettled", ~F.col("confident") | (F.lead("in_spec").over(w) != F.col("in_spec")))
    held = F.col("held_us").cast("double")
    known = F.count_if(F.col("sigma").isNotNull()) > 0
    total = F.nullif(F.sum(held), F.lit(0.0))
    lower = F.sum(F.when(F.col("in_spec") & ~F.col("unsettled"), held).otherwise(0.0)) / total
    upper = F.sum(F.when(F.col("in_spec") | F.col("unsettled"), held).otherwise(0.0)) / total
    return h.groupBy("record", "label").agg(F.when(known, lower).alias("lower"), F.when(known, upper).alias("upper"))


def run_length(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """Mean in-spec run in reads, and that times the out-of-spec share of reads (1 where reads are independent)."""
    share = rows.groupBy("record", "label").agg(F.avg(F.col("in_spec").cast("double")).alias("share"))
    runs = wins.filter(F.col("side") == IN).groupBy("record", "label").agg(F.try_divide(F.sum(F.col("n_reads") - F.col("censored").cast("long")).cast("double"), F.count_if(~F.col("censored")).cast("double")).alias("mean_run"))
    return share.join(runs, ["record", "label"], "left").withColumn("ratio", F.col("mean_run") * (1 - F.col("share")))


def in_spec_autocorrelation(rows: DataFrame, lags: int = 10) -> DataFrame:
    """Autocorrelation of the in-spec indicator at lags 1..lags inside segments, centred on the record's share of reads. Pairs are counted, so one division is the only rounding."""
    w, whole = in_time("label", "segment"), Window.partitionBy("record", "label")
    x = rows.withColumn("x", F.col("in_spec").cast("long")).withColumn("a", F.sum("x").over(whole)).withColumn("n", F.count("*").over(whole))
    cols = x.select("record", "label", "x", "a", "n", *[F.lead("x", h).over(w).alias(f"y{h}") for h in range(1, lags + 1)])
    stack = ", ".join(f"{h}L, y{h}" for h in range(1, lags + 1))
    ahead = cols.selectExpr("record", "label", "x", "a", "n - a as b", f"stack({lags}, {stack}) as (lag, y)").filter("y is not null and a > 0 and b > 0")
    pairs = ahead.groupBy("record", "label", "lag", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.count_if(F.col("x") != F.col("y")).alias("one"), F.count("*").alias("k"))
    return pairs.select("record", "label", "lag", F.expr("cast(both * b * b - one * a * b + (k - both - one) * a * a as double) / cast(k * a * b as double)").alias("rho"))
