"""Compositions: one wide or long table from several estimators, with a status beside every number that may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators import resolve


def status(value: Column, reason: str) -> Column:
    """``ok``, or why there is no number."""
    return F.when(value.isNull(), reason).otherwise("ok")


def edge_level(obs: DataFrame, spectrum: DataFrame, share: float = 0.1) -> DataFrame:
    """Mean density over the top share of the band (frequencies, not grid numbers), and the spectrum's peak."""
    band = obs.groupBy("record").agg((0.5e6 / F.median(F.when(F.col("dt_us") > 0, F.col("dt_us")))).alias("edge_hz"))
    rows = spectrum.filter("density is not null").join(band, "record")
    return rows.groupBy("record").agg(F.avg(F.when(F.col("f") >= (1 - share) * F.col("edge_hz"), F.col("density"))).alias("edge"), F.max("density").alias("peak")).filter("edge is not null")


def noise_floor(obs: DataFrame, spectrum: DataFrame) -> DataFrame:
    """What white noise of the stated errors would put into the edge level: 2 x mean squared error x median spacing over the level. An edge below 1e-12
    of the peak is the residue of a signal with no power there and has no ratio."""
    step = obs.groupBy("record").agg((F.median(F.when(F.col("dt_us") > 0, F.col("dt_us"))) / 1e6).alias("dt"))
    own = resolve.collapse_repeated(obs).groupBy("record").agg(F.avg(F.col("sigma") * F.col("sigma")).alias("s2")).join(step, "record")
    return own.join(edge_level(obs, spectrum), "record").select("record", F.when(F.col("edge") > 1e-12 * F.col("peak"), F.try_divide(2 * F.col("s2") * F.col("dt"), F.col("edge"))).alias("ratio"))


def tenth_ratio(variance: DataFrame) -> DataFrame:
    """Cumulative derivative variance at the top frequency over that at a tenth of it, interpolated."""
    w = Window.partitionBy("record").orderBy("k")
    rows = variance.withColumn("f0", F.coalesce(F.lag("f").over(w), F.lit(0.0))).withColumn("v0", F.coalesce(F.lag("variance").over(w), F.lit(0.0))).withColumn("top", F.max("f").over(Window.partitionBy("record"))).withColumn("all", F.max("variance").over(Window.partitionBy("record")))
    at = rows.filter((F.col("f0") < F.col("top") / 10) & (F.col("f") >= F.col("top") / 10))
    v = F.col("v0") + (F.col("top") / 10 - F.col("f0")) / (F.col("f") - F.col("f0")) * (F.col("variance") - F.col("v0"))
    return at.select("record", F.try_divide(F.col("all"), v).alias("g10"))


def spectral_levels(obs: DataFrame, spectrum: DataFrame, share: float = 0.1) -> DataFrame:
    """``noise_floor`` and ``tenth_ratio`` from one reading of the spectrum: record, noise_floor_ratio, g10; a row for each record with a density."""
    w = Window.partitionBy("record").orderBy("k")
    own = obs.groupBy("record").agg(F.median(F.when(F.col("dt_us") > 0, F.col("dt_us"))).alias("_step"))
    errors = resolve.collapse_repeated(obs).groupBy("record").agg(F.avg(F.col("sigma") * F.col("sigma")).alias("_s2"))
    rows = resolve.derivative_variance(spectrum).join(own.join(errors, "record"), "record")
    rows = rows.withColumn("_f0", F.coalesce(F.lag("f").over(w), F.lit(0.0))).withColumn("_v0", F.coalesce(F.lag("variance").over(w), F.lit(0.0))).withColumn("_tenth", F.max("f").over(Window.partitionBy("record")) / 10)
    v = F.col("_v0") + (F.col("_tenth") - F.col("_f0")) / (F.col("f") - F.col("_f0")) * (F.col("variance") - F.col("_v0"))
    at = rows.groupBy("record").agg(
        F.avg(F.when(F.col("f") >= (1 - share) * (0.5e6 / F.col("_step")), F.col("density"))).alias("_edge"), F.max("density").alias("_peak"), F.first("_step").alias("_step"), F.first("_s2").alias("_s2"),
        F.max("variance").alias("_all"), F.max(F.when((F.col("_f0") < F.col("_tenth")) & (F.col("f") >= F.col("_tenth")), v)).alias("_v"),
    )
    ratio = F.when(F.col("_edge") > 1e-12 * F.col("_peak"), F.try_divide(2 * F.col("_s2") * (F.col("_step") / 1e6), F.col("_edge")))
    return at.select("record", ratio.alias("noise_floor_ratio"), F.try_divide(F.col("_all"), F.col("_v")).alias("g10"))


def tellability(obs: DataFrame, dependence: DataFrame | None = None) -> DataFrame:
    """One row per record of everything that says whether it can resolve its own changes; with the panel of ``dependence.panel``, also whether its errors depend on its values: the panel's p,
    the members that attain it, and a status."""
    out = obs.select("record").distinct()
    for part in (
        resolve.second_difference(obs).withColumnRenamed("ratio", "difference_ratio"), spectral_levels(obs, resolve.lomb_scargle(obs)), resolve.band_maximum(obs),
        resolve.self_consistency(obs).withColumnRenamed("share", "consistency"), resolve.decile_spread(obs),
    ):
        out = out.join(part, "record", "left")
    for name, why in (("difference_ratio", "fewer than three reads in a segment"), ("noise_floor_ratio", "no spectrum or no known error"), ("g10", "no frequency around a tenth"), ("maximum", "no spacing"), ("consistency", "no known error"), ("spread", "fewer than ten reads")):
        out = out.withColumn(name + "_status", status(F.col(name), why))
    if dependence is None:
        return out
    own = dependence.groupBy("record").agg(F.first("panel_p").alias("dependence_p"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("attains"), F.col("member")))), ",").alias("dependence_members"), F.first("reason").alias("_why"))
    return out.join(own, "record", "left").withColumn("dependence_p_status", F.when(F.col("dependence_p").isNull(), F.coalesce("_why", F.lit("no read"))).otherwise("ok")).drop("_why")


def threshold_tellability(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """One row per record and rung: bounds, run length, count exponent and placement of crossings."""
    from tidespan.operators import carve

    out = rows.select("record", "label").distinct()
    for part in (carve.in_spec_bounds(rows), carve.run_length(rows, wins).select("record", "label", F.col("ratio").alias("run_ratio")), resolve.count_exponent(rows).select("record", "label", "exponent"), resolve.crossing_placement(rows)):
        out = out.join(part, ["record", "label"], "left")
    return out.fillna(0, ["clean", "merged", "unbracketed"])


def long_table(rows: DataFrame, key: list[str], quantities: list[str]) -> DataFrame:
    """(key, quantity, value): one row per number, missing ones left in as nulls."""
    return rows.unpivot(key, quantities, "quantity", "value")


def within_panel(occupancy: DataFrame, ttf: DataFrame, wins: DataFrame, bounds: DataFrame) -> DataFrame:
    """The panel of a record: shares, bounds, first failure and windows by how they end, per rung."""
    ends = wins.groupBy("record", "label").agg(F.count_if(F.col("side") == "in_spec").alias("n_windows"), F.count_if((F.col("side") == "in_spec") & F.col("censored")).alias("n_censored"), F.count_if((F.col("side") == "in_spec") & ~F.col("birth_seen")).alias("n_unseen"))
    return occupancy.join(ttf, ["record", "label"], "left").join(bounds, ["record", "label"], "left").join(ends, ["record", "label"], "left")


def cull_timelines(spans: DataFrame, occupancy: DataFrame, least: float = 0.05) -> DataFrame:
    """Timelines of rungs whose share of time in spec reaches ``least``."""
    return spans.join(occupancy.filter(F.col("occupancy") >= least).select("record", "label"), ["record", "label"], "left_semi")


def same_carve(wins: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows whose cell or time is not among the reads, and cells of reads without windows: must be empty."""
    a = wins.join(rows.select("record", "label", F.col("t_us").alias("birth_us")).distinct(), ["record", "label", "birth_us"], "left_anti").select("record", "label")
    b = rows.select("record", "label").distinct().join(wins.select("record", "label").distinct(), ["record", "label"], "left_anti")
    return a.unionByName(b)


def repeated_members(groups: DataFrame) -> DataFrame:
    """Records that stand in more than one group: must be empty before groups are compared."""
    return groups.select("record", "grp").distinct().groupBy("record").count().filter("count > 1").select("record")


def with_checks(pairs: DataFrame, attached: DataFrame) -> DataFrame:
    """Each side of a comparison with the verdicts of its own ledger. pairs: label, side, first, second, ..."""
    one = attached.select("label", "side", F.col("record").alias("first"), F.col("verdicts").alias("first_verdicts"))
    two = attached.select("label", "side", F.col("record").alias("second"), F.col("verdicts").alias("second_verdicts"))
    return pairs.join(one, ["label", "side", "first"], "left").join(two, ["label", "side", "second"], "left")


def divergence(rows: DataFrame, a: str, b: str, level: str, least: float) -> DataFrame:
    """First level at which two numbers part by more than ``least``, per key ``grp``."""
    return rows.filter(F.abs(F.col(a) - F.col(b)) > least).groupBy("grp").agg(F.min(level).alias("level"))
