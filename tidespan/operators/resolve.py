"""Can the record tell? Spacing, spectra, noise scales, crossing placement, count exponents; and Allan deviations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.fourier import exponential_sums
from tidespan.operators import deal
from tidespan.operators.carve import in_time

TWO_PI = 2 * math.pi
#: Allan factors of a segment in a task.
BLOCK = 2048


def collapse_repeated(reads: DataFrame) -> DataFrame:
    """Reads of one time become their mean; sigma is that of the mean, null if any is unknown."""
    s = F.when(F.count("sigma") == F.count("*"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count("*"))
    return reads.groupBy("record", "t_us").agg(F.avg("value").alias("value"), s.alias("sigma"), F.min("seq").alias("seq"))


def second_difference(obs: DataFrame) -> DataFrame:
    """Noise scale from pseudo-residuals of three neighbouring reads (Gasser, Sroka and Jennen-Steinmetz 1986), and its ratio to the standard deviation."""
    w = in_time("segment")
    rows = obs.withColumn("t0", F.lag("t_us").over(w)).withColumn("t2", F.lead("t_us").over(w)).withColumn("q0", F.lag("value").over(w)).withColumn("q2", F.lead("value").over(w)).filter("t0 is not null and t2 is not null and t2 > t0")
    a = (F.col("t2") - F.col("t_us")) / (F.col("t2") - F.col("t0"))
    e = a * F.col("q0") + (1 - a) * F.col("q2") - F.col("value")
    scale = rows.groupBy("record").agg(F.sqrt(F.avg(e * e / (a * a + (1 - a) * (1 - a) + 1))).alias("scale"))
    sd = obs.groupBy("record").agg(F.stddev_samp("value").alias("sd"), F.avg("sigma").alias("mean_sigma"))
    return scale.join(sd, "record").select("record", "scale", F.try_divide("scale", "sd").alias("ratio"), F.try_divide("mean_sigma", "scale").alias("sigma_ratio"))


def self_consistency(reads: DataFrame) -> DataFrame:
    """(variance - mean squared error) / variance."""
    v = F.var_samp("value")
    return reads.groupBy("record").agg(F.try_divide(v - F.avg(F.col("sigma") * F.col("sigma")), v).alias("share"))


def count_exponent(rows: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 5, 8, 13, 20)) -> DataFrame:
    """1 minus the slope of log(down-crossings per observed step) against log lag, over lags with crossings."""
    w = in_time("label", "segment")
    cols = rows.select("record", "label", "in_spec", "t_us", "seq", "segment", *[F.lead("in_spec", m).over(w).alias(f"y{m}") for m in lags])
    stack = ", ".join(f"{m}L, y{m}" for m in lags)
    pairs = cols.selectExpr("record", "label", "in_spec", f"stack({len(lags)}, {stack}) as (m, y)")
    counts = pairs.groupBy("record", "label", "m").agg((F.count_if(F.col("in_spec") & ~F.col("y")) / F.first("m")).alias("n"), (F.count("y") / F.first("m")).alias("p")).filter("n > 0 and p > 0")
    x, y = F.ln(F.col("m").cast("double")), F.ln(F.col("n") / F.col("p"))
    out = counts.withColumn("x", x).withColumn("y", y).groupBy("record", "label").agg(F.count("*").alias("n_lags"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"))
    return out.filter("n_lags >= 2").select("record", "label", "n_lags", (1 - F.col("c") / F.nullif("v", F.lit(0.0))).alias("exponent"))


def crossing_placement(rows: DataFrame) -> DataFrame:
    """Down-crossings as clean, merged or unbracketed, by the nearest confident reads on either side within the segment."""
    w = in_time("label", "segment")
    sure = F.when(F.col("confident"), F.struct("rn", "in_spec", "changes"))
    step = rows.withColumn("changed", F.coalesce((F.lag("in_spec").over(w) != F.col("in_spec")).cast("long"), F.lit(0))).withColumn("changes", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = step.withColumn("before", F.last(sure, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(sure, True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("goes", F.col("in_spec") & ~F.lead("in_spec").over(w))
    down = step.filter("goes")
    good = F.coalesce(F.col("before.in_spec") & ~F.col("after.in_spec"), F.lit(False))
    one = F.col("after.changes") - F.col("before.changes") == 1
    return down.groupBy("record", "label").agg(F.count_if(good & one).alias("clean"), F.count_if(good & ~one).alias("merged"), F.count_if(~good).alias("unbracketed"))


def _median_step(t: np.ndarray) -> float:
    """Median positive spacing, nan if there is none."""
    d = np.diff(t)
    return float(np.median(d[d > 0])) if (d > 0).any() else math.nan


def _by_record(obs: DataFrame, columns: list[str], work: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """``work`` over the arrays of each record, in the order of time: one exchange by record, n log n in its task."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t_us", "ascending"), ("seq", "ascending")])
        out = work(*(rows[c].to_numpy() for c in ["t_us", *columns]))
        record = pa.array([rows["record"][0].as_py()] * len(out[0]), rows.schema.field("record").type)
        return pa.Table.from_arrays([record, *(pa.array(x, from_pandas=True) for x in out)], names=["record", *names])

    kind, names = obs.schema["record"].dataType.simpleString(), [x.split()[0] for x in schema.split(", ")]
    return deal.by_key(obs.select("record", "t_us", "seq", *columns), "record").groupBy("record").applyInArrow(run, f"record {kind}, {schema}")


def _window(t: np.ndarray) -> list[np.ndarray]:
    span, step = float(t[-1] - t[0]), _median_step(t)
    top = math.floor(span / (2 * step)) if step > 0 else 0
    if top < 1:
        return [np.array([], np.int64), np.array([])]
    sums = exponential_sums((t - t[0]) / span, np.ones(len(t)), top)[1:]
    return [np.arange(1, top + 1), np.abs(sums) ** 2 / len(t) ** 2]


def spectral_window(obs: DataFrame) -> DataFrame:
    """|sum exp(-2 pi i f t)|^2 / n^2 on the grid k / T, T the record's span, up to the band edge, half the inverse of the median positive spacing.
    Columns record, k, window; a span below two median spacings has no frequency and no row."""
    return _by_record(obs, [], _window, "k long, window double")


def _density(t: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    none = [np.array([], np.int64), np.array([]), np.array([])]
    span, step = float(t[-1] - t[0]), _median_step(t)
    top = math.floor(span / (2 * step)) if step > 0 else 0
    at, place = np.unique(t, return_inverse=True)
    y = np.bincount(place, value) / np.bincount(place)  # reads of one time count as their mean
    if top < 1 or np.ptp(value) == 0 or np.ptp(y) == 0:
        return none
    x, n, y = (at - at[0]) / span, len(at), y - y.mean()
    ones, sums = exponential_sums(x, np.ones(n), 2 * top) / n, exponential_sums(x, y, top)[1:] / n
    c, s, c2, s2 = ones[1 : top + 1].real, -ones[1 : top + 1].imag, ones[2::2].real, -ones[2::2].imag
    yc, ys = sums.real, -sums.imag
    cc, ss, cs = (1 + c2) / 2 - c * c, (1 - c2) / 2 - s * s, s2 / 2 - c * s
    det = cc * ss - cs * cs
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.where(det > 1e-9, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / det * n / 2, np.nan)
    k = np.arange(1, top + 1)
    return [k, k / (span / 1e6), 2 * step / 1e6 * power]


def lomb_scargle(obs: DataFrame) -> DataFrame:
    """Floating-mean periodogram (Zechmeister and Kuerster 2009) on the grid of ``spectral_window``, as a one-sided density: 2 x median spacing x power.
    Columns record, k, f, density; reads of one time are averaged; values of zero range have no rows. Where sine and cosine at the reads are
    one function (an even lattice at its band edge) there is no power: null."""
    return _by_record(obs, ["value"], _density, "k long, f double, density double")


def _band_maximum(t: np.ndarray) -> list[np.ndarray]:
    step = _median_step(t)
    if not step > 0:
        return [np.array([])]
    rel, fs = (t - t[0]) / 1e6, 1e6 / step
    steps = 2 * math.ceil(2 * rel[-1] * fs)
    sums = exponential_sums(fs / steps * rel, np.exp(-1j * math.pi * fs * rel), steps)
    return [np.array([np.max(np.abs(sums)) ** 2 / len(t) ** 2])]


def band_maximum(obs: DataFrame) -> DataFrame:
    """Largest spectral-window power on [fs/2, 3 fs/2], fs the inverse of the median positive spacing, in even steps of 1 / (4 T) at most."""
    return _by_record(obs, [], _band_maximum, "maximum double")


def derivative_variance(spectrum: DataFrame) -> DataFrame:
    """Cumulative integral of (2 pi f)^2 S from 0, the head flat: trapezoid over the grid; and the share of it below each frequency."""
    w = Window.partitionBy("record").orderBy("k")
    y = F.pow(TWO_PI * F.col("f"), 2) * F.col("density")
    rows = spectrum.filter("density is not null").withColumn("y", y)
    head = F.pow(F.lit(TWO_PI), 2) * F.col("density") * F.pow(F.col("f"), 3) / 3
    area = F.coalesce((F.col("f") - F.lag("f").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2, head)
    rows = rows.withColumn("area", area).withColumn("variance", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("share", F.try_divide("variance", F.max("variance").over(Window.partitionBy("record"))))


def allan_deviation(obs: DataFrame, least: int = 8, octaves: bool = False) -> DataFrame:
    """Overlapping Allan deviation at all factors up to half a segment (or at powers of two), pooled over segments by term count. Phase is the
    running sum of values less the segment mean, from 0. A segment's factors are dealt to tasks in blocks; columns record, m, n_terms, adev, adev_err."""
    path = obs.groupBy("record", "segment").agg(F.array_sort(F.collect_list(F.struct("t_us", "seq", "value"))).alias("p"), F.count("*").alias("size")).filter("size >= 2")
    blocks = path.select("record", F.expr("transform(p, a -> a.value)").alias("y"), F.expr(f"explode(sequence(1L, size div 2, {BLOCK}L))").alias("low"))
    kind, width = obs.schema["record"].dataType.simpleString(), BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record, m, squares, terms = [], [], [], []
            for i in range(batch.num_rows):
                y = batch["y"][i].values.to_numpy()
                x = np.concatenate([[0.0], np.cumsum(y - y.mean())])
                low = batch["low"][i].as_py()
                for k in range(low, min(low + width - 1, len(y) // 2) + 1):
                    if octaves and k & (k - 1):
                        continue
                    d = x[2 * k :] - 2 * x[k:-k] + x[: -2 * k]
                    record.append(batch["record"][i].as_py()), m.append(k), squares.append(float(d @ d)), terms.append(len(d))
            yield pa.RecordBatch.from_arrays([pa.array(record, batch.schema.field("record").type), pa.array(m, pa.int64()), pa.array(squares, pa.float64()), pa.array(terms, pa.int64())], names=["record", "m", "s", "n_terms"])

    sums = blocks.repartition("record", "low").mapInArrow(work, f"record {kind}, m long, s double, n_terms long")
    out = sums.groupBy("record", "m").agg(F.sum("s").alias("s"), F.sum("n_terms").alias("n_terms")).filter(F.col("n_terms") >= least)
    return out.withColumn("adev", F.sqrt(F.col("s") / (2.0 * F.col("m") * F.col("m") * F.col("n_terms")))).withColumn("adev_err", F.col("adev") / F.sqrt(F.col("n_terms").cast("double"))).drop("s")


def dwells(runs: DataFrame) -> DataFrame:
    """runs: windows of a two-state cut -> per state exposure, exits, mean dwell (exposure over exits), complete runs and their variation (three or more)."""
    full = F.when(F.col("birth_seen") & ~F.col("censored"), F.col("duration_s"))
    out = runs.groupBy("record", "label", "side").agg(F.sum("duration_s").alias("exposure_s"), F.count_if(~F.col("censored")).alias("exits"), F.count(full).alias("n_complete"), F.when(F.count(full) >= 3, F.try_divide(F.stddev_samp(full), F.avg(full))).alias("cv"))
    return out.withColumn("mean_dwell_s", F.try_divide(F.col("exposure_s"), F.col("exits").cast("double")))


def decile_spread(reads: DataFrame, parts: int = 10) -> DataFrame:
    """Range over positions-in-order tenths of the mean value, over the standard deviation."""
    rows = reads.withColumn("part", F.ntile(parts).over(in_time()))
    means = rows.groupBy("record", "part").agg(F.avg("value").alias("m"))
    sd = reads.groupBy("record").agg(F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    return means.groupBy("record").agg((F.max("m") - F.min("m")).alias("range")).join(sd, "record").filter(F.col("n") >= parts).select("record", F.try_divide("range", "sd").alias("spread"))
