"""Renewal segments and the checks on them: trend (C1, C2, CvM), dependence (C5, C6), permutations, min-P, verdicts.

Everything works on one long table of gaps: a cell (record, label, side), a draw ``b`` (0 is the order as observed), a segment, a
position and a gap. A statistic is a grouped sum over running sums. Batteries of permutations take a cell's arrays at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.special import normal_quantile
from tidespan.operators import deal

CELL = ["record", "label", "side"]
AT_EVENT = 1 + 1e-12
TREND, DEPENDENCE = ("c1", "c2", "cvm"), ("c5", "c6")
TIE_SENSITIVE = ("c5", "c6", "dependence")


def side_gaps(wins: DataFrame) -> DataFrame:
    """Side clock: complete windows born by a crossing, in order, per segment; tau is the time on the side after a leading unseen start."""
    seen = wins.filter("birth_seen")
    tau = F.sum("duration_s").over(Window.partitionBy(*CELL, "segment"))
    rows = seen.withColumn("tau", tau).filter("not censored").withColumn("i", F.row_number().over(Window.partitionBy(*CELL, "segment").orderBy("birth_us", "island")))
    return rows.select(*CELL, "segment", F.col("i").cast("long").alias("i"), F.col("duration_s").alias("x"), "tau")


def calendar_gaps(wins: DataFrame, segments: DataFrame) -> DataFrame:
    """Calendar clock: time between births seen; tau runs from the first of them to the end of the segment's observation."""
    w = Window.partitionBy(*CELL, "segment").orderBy("birth_us", "island")
    births = wins.filter("birth_seen").withColumn("first_us", F.min("birth_us").over(Window.partitionBy(*CELL, "segment"))).withColumn("x", (F.col("birth_us") - F.lag("birth_us").over(w)) / 1e6)
    rows = births.filter("x is not null").join(segments.select("record", "segment", "end_us"), ["record", "segment"])
    return rows.select(*CELL, "segment", F.row_number().over(w).cast("long").alias("i"), "x", ((F.col("end_us") - F.col("first_us")) / 1e6).alias("tau"))


def usable(gaps: DataFrame, least: int = 3) -> DataFrame:
    """Segments of ``least`` gaps or more that are positive and not all equal."""
    w = Window.partitionBy(*CELL, "segment")
    rows = gaps.withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w))
    return rows.filter((F.col("n") >= max(2, least)) & (F.col("lo") > 0) & (F.col("hi") > F.col("lo"))).drop("lo", "hi")


def unusable(gaps: DataFrame, least: int = 3) -> DataFrame:
    """The segments that ``usable`` leaves out, each with its gaps and the reason: cell, segment, n, reason."""
    seg = gaps.groupBy(*CELL, "segment").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    reason = F.when(F.col("n") < max(2, least), f"fewer than {max(2, least)} gaps").when(F.col("lo") <= 0, "a gap is not positive").when(F.col("hi") <= F.col("lo"), "all gaps are equal")
    return seg.withColumn("reason", reason).filter("reason is not null").drop("lo", "hi")


def gamma(gaps: DataFrame, estimator: str = "sample") -> DataFrame:
    """Coefficient of variation of each segment's gaps: sample, population, or truncated (the residual folded in)."""
    seg = gaps.groupBy(*CELL, "segment").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("sdp"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("x").alias("t"), F.first("tau").alias("tau"))
    if estimator == "sample":
        g: Column = F.col("sd") / F.col("mean")
    elif estimator == "population":
        g = F.col("sdp") / F.col("mean")
    elif estimator == "truncated":
        mu = F.col("tau") / F.col("n")
        var = (F.col("xx") + F.pow(F.col("tau") - F.col("t"), 2)) / F.col("n") - mu * mu
        g = F.when(var > 0, F.sqrt(F.when(var > 0, var)) / mu)
    else:
        raise ValueError(f"unknown estimator {estimator!r}")
    return seg.select(*CELL, "segment", g.alias("gamma"))


#: A prime: draw keys are squares modulo it, so that their products fit 64 bits in every engine.
PRIME = 2_147_483_647


def gap_hash(seed: int) -> Column:
    """A number below PRIME from the name of a gap (cell, segment, i), made once per gap."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *CELL, "segment", "i")), 1, 8), 16, 10).cast("long") % PRIME


def draw_factors(n_draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each draw: the factor and the shift of its keys."""
    h = [hashlib.md5(f"{seed}|{b}".encode()).hexdigest() for b in range(n_draws + 1)]
    return np.array([int(x[:8], 16) % (PRIME - 1) + 1 for x in h]), np.array([int(x[8:16], 16) % PRIME for x in h])


def _draw_keys(h: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """((h x factor + shift) mod PRIME)^2 mod PRIME of each draw and hashed place. PRIME is 2^31 - 1, so 2^31 counts as 1 and high bits are added to the low ones; the square of
    what one such step leaves (below 2^32) still fits 64 bits."""
    prime = np.uint64(PRIME)
    z = np.multiply(h.astype(np.uint64), factor.astype(np.uint64)[:, None])
    z += shift.astype(np.uint64)[:, None]
    room = np.empty_like(z)
    for square in (True, False, False):
        np.right_shift(z, np.uint64(31), out=room)
        z &= prime
        z += room
        if square:
            np.multiply(z, z, out=z)
    np.subtract(z, prime, out=room)  # wraps to a large number where z is below PRIME
    return np.minimum(z, room, out=z).view(np.int64)


def shuffled(h: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The order of the hashed places h in each draw, ties by place: keys and places are packed into one number, so a plain sort orders both."""
    key = _draw_keys(h, factor, shift)
    key <<= 32
    key |= np.arange(len(h))
    key.sort(axis=1)
    key &= 0xFFFFFFFF
    return key


def draws(gaps: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """The gaps in ``n_draws`` shuffled orders beside the observed one (b = 0). A draw orders a segment by ((hash x factor + shift) mod PRIME)^2 mod PRIME, then by i:
    one digest a gap and arithmetic a draw, which any engine can repeat."""
    if n_draws == 0:
        return gaps.withColumn("b", F.lit(0).cast("long")).withColumn("pos", F.col("i"))
    factors = gaps.sparkSession.createDataFrame([(b, int(k), int(c)) for b, (k, c) in enumerate(zip(*draw_factors(n_draws, seed)))], "b long, _factor long, _shift long")
    many = gaps.withColumn("_hash", gap_hash(seed)).crossJoin(F.broadcast(factors))
    z = (F.col("_hash") * F.col("_factor") + F.col("_shift")) % PRIME
    order = Window.partitionBy(*CELL, "b", "segment").orderBy(F.when(F.col("b") > 0, z * z % PRIME), "i")
    return many.withColumn("pos", F.row_number().over(order).cast("long")).drop("_hash", "_factor", "_shift")


def trend_statistics(orders: DataFrame, gammas: DataFrame) -> DataFrame:
    """C1 (signed), C2 and CvM of each cell and draw. A segment that ends at an event is read through its first n - 1 gaps."""
    w = Window.partitionBy(*CELL, "b", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = orders.withColumn("T", F.sum("x").over(w)).withColumn("total", F.sum("x").over(Window.partitionBy(*CELL, "b", "segment")))
    rows = rows.withColumn("N", F.when(F.col("tau") <= F.col("total") * AT_EVENT, F.col("n") - 1).otherwise(F.col("n"))).filter("pos <= N")
    o = Window.partitionBy(*CELL, "b", "segment").orderBy("pos")
    rows = rows.withColumn("P", F.coalesce(F.lag("T").over(o), F.lit(0.0)))
    i, n, t, p, tau = F.col("pos") - 1, F.col("N"), F.col("T"), F.col("P"), F.col("tau")
    safe = lambda x: F.ln(F.when(x > 0, x))
    head = F.when(i >= 1, F.pow(n - i, 2) * safe((tau - p) / F.nullif(tau - t, F.lit(0.0))) + i * i * safe(t / F.nullif(p, F.lit(0.0)))).otherwise(0.0)
    u, v = t / tau, p / tau
    walk = i * i * (u - v) - i * n * (u * u - v * v)
    seg = rows.groupBy(*CELL, "b", "segment").agg(F.first("N").alias("N"), F.first("tau").alias("tau"), F.sum("T").alias("sum_t"), F.sum(head).alias("head"), F.sum(walk).alias("walk"), F.min("T").alias("t1"), F.max("T").alias("tn")).join(gammas, [*CELL, "segment"])
    n, tau, g = F.col("N"), F.col("tau"), F.col("gamma")
    c = 1 / (tau * g * g)
    tail = n * n * (safe(tau / F.nullif(tau - F.col("t1"), F.lit(0.0))) + safe(tau / F.col("tn")) - 1)
    un = F.col("tn") / tau
    return seg.groupBy(*CELL, "b").agg(
        F.count("*").alias("n_segments"), F.sum("N").alias("n_events"),
        (F.sqrt(F.lit(12.0)) * F.sum(c * (F.col("sum_t") - n * tau / 2)) / F.sqrt(F.sum(c * c * g * g * tau * tau * n))).alias("c1"),
        F.sum((F.col("head") + tail) / (g * g * n)).alias("c2"), F.sum((F.col("walk") + n * n * (un * un - un + 1.0 / 3)) / (g * g * n)).alias("cvm"),
    )


def mid_ranks(gaps: DataFrame) -> DataFrame:
    """Average ranks over all gaps of a cell, centred (c), with the cell's sum of squares (cc). Constant cells are left out."""
    w = Window.partitionBy(*CELL)
    ranked = gaps.withColumn("rank", F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy(*CELL, "x")) - 1) / 2)
    c = F.col("rank") - F.avg("rank").over(w)
    return ranked.withColumn("c", c).withColumn("cc", F.sum(F.col("c") * F.col("c")).over(w)).filter("cc > 0")


def rank_autocorrelation(orders: DataFrame, max_lag: int = 5) -> DataFrame:
    """orders: mid-ranked gaps with b and pos -> cell, b, lag, n_pairs, r, over pairs inside segments; a lag needs two pairs, and every shorter lag its own."""
    w = Window.partitionBy(*CELL, "b", "segment").orderBy("pos")
    wide = orders.select(*CELL, "b", "c", "cc", *[F.lead("c", h).over(w).alias(f"y{h}") for h in range(1, max_lag + 1)])
    stack = ", ".join(f"{h}L, y{h}" for h in range(1, max_lag + 1))
    pairs = wide.selectExpr(*CELL, "b", "c", "cc", f"stack({max_lag}, {stack}) as (lag, y)").filter("y is not null")
    return pairs.groupBy(*CELL, "b", "lag").agg(F.count("*").alias("n_pairs"), (F.sum(F.col("c") * F.col("y")) / F.first("cc")).alias("r")).filter("n_pairs >= 2")


def dependence_statistics(acf: DataFrame) -> DataFrame:
    """C5 (largest |z|) and C6 (sum of z^2) of each cell and draw, each lag scaled by its own moments over all draws. A lag without spread makes the cell undefined (nulls)."""
    w = Window.partitionBy(*CELL, "lag")
    z = acf.withColumn("spread", F.max("r").over(w) - F.min("r").over(w)).withColumn("z", F.when(F.col("spread") > 1e-12, (F.col("r") - F.avg("r").over(w)) / F.nullif(F.stddev_pop("r").over(w), F.lit(0.0))))
    return z.groupBy(*CELL, "b").agg(F.when(F.count("z") == F.count("*"), F.max(F.abs("z"))).alias("c5"), F.when(F.count("z") == F.count("*"), F.sum(F.col("z") * F.col("z"))).alias("c6"))


def long_statistics(statistics: DataFrame, names: tuple[str, ...], digits: int = 9) -> DataFrame:
    """cell, b, check, s: one row per statistic, C1 by its size. Values are rounded, so equal ones tie in every engine."""
    pairs = ", ".join(f"'{m}', round({'abs(c1)' if m == 'c1' else m}, {digits})" for m in names)
    return statistics.selectExpr(*CELL, "b", f"stack({len(names)}, {pairs}) as (check, s)")


def p_values(long: DataFrame) -> DataFrame:
    """(1 + draws at least as large as observed) / (1 + draws), per cell and check, where the observed value is defined."""
    rows = long.withColumn("seen", F.max(F.when(F.col("b") == 0, F.col("s"))).over(Window.partitionBy(*CELL, "check"))).filter("seen is not null")
    got = rows.groupBy(*CELL, "check").agg(F.first("seen").alias("statistic"), (F.count_if((F.col("b") > 0) & (F.col("s") >= F.col("seen"))) + 1).alias("k"), F.count("*").alias("n"))
    return got.select(*CELL, "check", "statistic", (F.col("k") / F.col("n")).alias("p"))


def _log_part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln(x / y), not a number where it has no value."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = x / np.where(y == 0, np.nan, y)
        return np.log(np.where(q > 0, q, np.nan))


def _trend_with_gaps(t: np.ndarray, tau: float, gamma: float, events: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parts of ``_trend_of`` term by term, where draws read different numbers of events or a logarithm has no value."""
    n, p = t.shape[1], np.concatenate([np.zeros((len(t), 1)), t[:, :-1]], axis=1)
    events = events[:, None]
    i, read = np.arange(n)[None, :], np.arange(n)[None, :] < events
    head = np.where(i >= 1, (events - i) ** 2 * _log_part(tau - p, tau - t) + i * i * _log_part(t, np.where(i >= 1, p, 1.0)), 0.0)
    u, v = t / tau, p / tau
    walk = i * i * (u - v) - i * events * (u * u - v * v)
    add = lambda a: np.nansum(np.where(read, a, 0.0), axis=1)
    events, last = events[:, 0], np.take_along_axis(t, events - 1, axis=1)[:, 0]
    tail = events**2 * (_log_part(np.full(len(t), tau), tau - t[:, 0]) + _log_part(np.full(len(t), tau), last) - 1)
    c, end, g2n = 1 / (tau * gamma * gamma), last / tau, gamma * gamma * events
    return c * (add(t) - events * tau / 2), c * c * gamma * gamma * tau * tau * events, (add(head) + tail) / g2n, (add(walk) + events**2 * (end * end - end + 1.0 / 3)) / g2n, events


def _trend_of(x: np.ndarray, tau: float, gamma: float) -> tuple[np.ndarray, ...]:
    """x: draws by gaps of one segment -> its parts of C1 (numerator, square of the denominator), C2 and CvM, and the events read, of each draw.
    Sums of differences of neighbours are sums of the terms themselves by other weights, so a draw takes two logarithms a gap and products with fixed vectors."""
    t = np.cumsum(x, axis=1)
    events = np.where(tau <= t[:, -1] * AT_EVENT, x.shape[1] - 1, x.shape[1])
    n = int(events[0])
    if (events != n).any() or not (t[:, 0].min() > 0 and tau > t[:, n - 1].max()):
        return _trend_with_gaps(t, tau, gamma, events)
    t, i, more = t[:, :n], np.arange(n), np.arange(n) < n - 1
    on, off = np.where(i >= 1, i, 0), np.where(more, i + 1, 0)  # a term's place as the end and as the start of a step
    u = t / tau
    far, near = np.log((tau - t) / tau), np.log(u)
    head = far @ (np.where(more, (n - off) ** 2, 0) - np.where(i >= 1, (n - on) ** 2, 0)).astype(float) + near @ (on**2 - off**2).astype(float)
    walk = u @ (on**2 - off**2).astype(float) + (u * u) @ (n * (off - on)).astype(float)
    tail = -n * n * (far[:, 0] + near[:, -1] + 1)
    c, end, g2n = 1 / (tau * gamma * gamma), u[:, -1], gamma * gamma * n
    return c * (t.sum(axis=1) - n * tau / 2), np.full(len(t), c * c * gamma * gamma * tau * tau * n), (head + tail) / g2n, (walk + n * n * (end * end - end + 1.0 / 3)) / g2n, events


def _cell_arrays(segment: np.ndarray, x: np.ndarray, tau: np.ndarray, h: np.ndarray, factors: tuple[np.ndarray, np.ndarray], max_lag: int, most: int = 4_000_000) -> tuple[int, np.ndarray, dict[str, np.ndarray]]:
    """One cell's gaps, by segment and place -> its segments, the events read and all statistics of all draws. Draws go in blocks, so that a block holds ``most`` numbers at most (or one draw)."""
    _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    rank = rank - rank.mean()
    runs = np.split(np.arange(len(x)), np.flatnonzero(np.diff(segment)) + 1)
    gammas = [x[rows].std(ddof=1) / x[rows].mean() for rows in runs]
    n, step, parts, lags = len(factors[0]), max(1, most // len(x)), [], []
    for low in range(0, n, step):
        k, c = (f[low : low + step] for f in factors)
        trend, moved = 0, np.zeros((len(k), max_lag))
        for rows, gamma in zip(runs, gammas, strict=True):
            order = shuffled(h[rows], k, c)
            if low == 0:
                order[0] = np.arange(len(rows))
            trend = trend + np.stack(_trend_of(x[rows][order], tau[rows[0]], gamma))
            c_ = rank[rows][order]
            for lag in range(1, min(max_lag, len(rows) - 1) + 1):
                moved[:, lag - 1] += np.einsum("ij,ij->i", c_[:, :-lag], c_[:, lag:])
        parts.append(trend)
        lags.append(moved)
    above, below, c2, cvm, events = np.concatenate(parts, axis=1)
    pairs = np.array([sum(max(0, len(r) - lag) for r in runs) for lag in range(1, max_lag + 1)])
    acf = np.concatenate(lags)[:, pairs >= 2] / (rank @ rank)
    spread, sd = np.ptp(acf, axis=0), acf.std(axis=0)
    c5 = c6 = np.full(n, np.nan)
    if acf.shape[1] and (spread > 1e-12).all():
        z = (acf - acf.mean(axis=0)) / sd
        c5, c6 = np.abs(z).max(axis=1), (z * z).sum(axis=1)
    return len(runs), events.astype(np.int64), {"c1": np.sqrt(12.0) * above / np.sqrt(below), "c2": c2, "cvm": cvm, "c5": c5, "c6": c6}


#: Gaps of cells that are shuffled together, the numbers in a block of their draws, and the gaps up to which a segment has a table of all its partial sums.
TOGETHER, CACHED, TABLED = 2_048, 65_536, 10
#: The number of members of each subset of ``TABLED`` things.
SUBSETS = np.array([bin(k).count("1") for k in range(1 << TABLED)])


def _trend_terms(t: np.ndarray, i: np.ndarray, tau: np.ndarray, gamma: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """What the end of gap i (from 0, of m read) at t adds to C1's numerator, C2 and CvM, as in ``_trend_of``; 0 where the gap is not read. Constants of the segment are left out."""
    more, read = i < m - 1, (i >= 0) & (i < m)
    on, off = np.where(i >= 1, i, 0), np.where(more, i + 1, 0)
    last, g2n = np.where(more, 0, m * m), np.where(read, 1 / (gamma * gamma * m), 0.0)
    by_far = (np.where(more, (m - off) ** 2, 0) - np.where(i >= 1, (m - on) ** 2, m * m)) * g2n
    by_near, by_uu = (on**2 - off**2 - last) * g2n, (m * (off - on) + last) * g2n
    t = np.where(read, t, tau / 2) if not read.all() else t
    u = t / tau
    return [np.where(read, 1 / (gamma * gamma), 0.0) * u, by_near * np.log(u) + by_far * np.log((tau - t) / tau), (by_near + by_uu * u) * u]


def _partial_sums(x: np.ndarray) -> np.ndarray:
    """The sum of each subset of x, its bits the members."""
    t = np.zeros(1)
    for v in x:
        t = np.concatenate([t, t + v])
    return t


def _several_cells(starts: np.ndarray, segment: np.ndarray, x: np.ndarray, tau: np.ndarray, h: np.ndarray, factors: tuple[np.ndarray, np.ndarray], max_lag: int) -> list[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """What ``_cell_arrays`` gives of each cell (``starts``: its first gap), from arrays that hold the gaps of all of them: one sort and a few array operations
    serve a block of draws. A cell whose draws may read different numbers of events, or whose logarithms may have no value, goes alone."""
    size, n = len(x), len(factors[0])
    ends = np.r_[starts[1:], size]
    cell = np.repeat(np.arange(len(starts)), ends - starts)
    first = np.flatnonzero(np.r_[True, (np.diff(segment) != 0) | (np.diff(cell) != 0)])
    count = np.diff(np.r_[first, size])
    run = np.repeat(np.arange(len(first)), count)
    total, least, end = np.add.reduceat(x, first), np.minimum.reduceat(x, first), tau[first]
    slack = total * (4e-16 * count + 1e-15)  # what sums in other orders differ by
    at_end = end <= total * AT_EVENT
    regular = (least > 0) & (np.abs(end - total * AT_EVENT) > slack) & np.where(at_end, end > total - least + slack, end > total + slack)
    alone = np.logical_or.reduceat(~regular, np.searchsorted(first, starts))
    if len(first).bit_length() + size.bit_length() > 32 or alone.all():
        return [_cell_arrays(*(v[a:b] for v in (segment, x, tau, h)), factors, max_lag) for a, b in zip(starts, ends, strict=True)]
    if alone.any():
        kept = np.flatnonzero(~alone[cell])
        sizes = (ends - starts)[~alone]
        rest = iter(_several_cells(np.cumsum(sizes) - sizes, segment[kept], x[kept], tau[kept], h[kept], factors, max_lag))
        return [_cell_arrays(*(v[a:b] for v in (segment, x, tau, h)), factors, max_lag) if one else next(rest) for a, b, one in zip(starts, ends, alone, strict=True)]

    # mid-ranks in the cell, centred
    by = np.lexsort((x, cell))
    tied = np.flatnonzero(np.r_[True, (np.diff(x[by]) != 0) | (np.diff(cell[by]) != 0)])
    times = np.diff(np.r_[tied, size])
    rank = np.empty(size)
    rank[by] = np.repeat(tied + (times - 1) / 2, times)
    rank -= (np.add.reduceat(rank, starts) / (ends - starts))[cell]

    # a partial sum is one of the 2^n subsets of a short segment's gaps, so what each adds stands in a table and draws only look it up
    mean = total / count
    gamma = np.sqrt(np.add.reduceat((x - mean[run]) ** 2, first) / (count - 1)) / mean
    events = count - at_end
    place, n_cells, short = np.arange(size) - first[run], len(starts), np.flatnonzero(count <= TABLED)
    if len(short):
        sums = [_partial_sums(x[first[k] : first[k] + count[k]]) for k in short]
        k = np.repeat(short, 1 << count[short])
        members = np.concatenate([SUBSETS[: len(v)] for v in sums])
        tables = _trend_terms(np.concatenate(sums), members - 1, end[k], gamma[k], events[k])
    offset = np.zeros(len(first), np.int64)
    offset[short] = np.cumsum(1 << count[short]) - (1 << count[short])
    tabled, rest = np.flatnonzero((count <= TABLED)[run]), np.flatnonzero((count > TABLED)[run])
    k = run[rest][:, None]
    of_rest = (place[rest][:, None], end[k], gamma[k], events[k])
    slices = [[(j, slice(*np.searchsorted(cell[rows], [j, j + 1]))) for j in np.unique(cell[rows])] for rows in (tabled, rest)]
    at = np.searchsorted(first, starts)
    pairs = np.add.reduceat(np.maximum(0, count[:, None] - np.arange(1, max_lag + 1)), at)

    trend, moved = np.zeros((3, n_cells, n)), np.zeros((n_cells, max_lag, n))
    bits, step = size.bit_length(), max(1, CACHED // size)
    label = run << 31 + bits | np.arange(size)
    for low in range(0, n, step):
        block = slice(low, min(low + step, n))
        key = _draw_keys(h, factors[0][block], factors[1][block])
        key <<= bits
        key |= label
        key.sort(axis=1)
        key &= (1 << bits) - 1
        if low == 0:
            key[0] = np.arange(size)
        order = np.ascontiguousarray(key.T)  # gaps by draws from here on
        if len(tabled):
            seen = np.take(1 << place, order if len(tabled) == size else order[tabled], mode="clip")
            for row in np.flatnonzero(place[tabled] > 0):
                seen[row] |= seen[row - 1]
            seen += offset[run[tabled]][:, None]
            room = np.empty(seen.shape)
            for table, out in zip(tables, trend, strict=True):
                np.take(table, seen, out=room, mode="clip")
                for j, rows in slices[0]:
                    out[j, block] += room[rows].sum(axis=0)
        if len(rest):
            t = x[order[rest]]
            for row in np.flatnonzero(place[rest] > 0):
                t[row] += t[row - 1]
            for terms, out in zip(_trend_terms(t, *of_rest), trend, strict=True):
                for j, rows in slices[1]:
                    out[j, block] += terms[rows].sum(axis=0)
        r = np.take(rank, order, mode="clip")
        for a, b, j in zip(first, first + count, cell[first], strict=True):
            for lag in range(1, min(max_lag, b - a - 1) + 1):
                moved[j, lag - 1, block] += np.einsum("ij,ij->j", r[a : b - lag], r[a + lag : b])
    c1, c2, cvm = trend
    some = np.add.reduceat(events / (gamma * gamma), at)[:, None]
    c1 -= np.add.reduceat(events / (2 * gamma * gamma), at)[:, None]
    c1 *= np.sqrt(12.0 / some)
    c2 -= np.add.reduceat(events / (gamma * gamma), at)[:, None]
    cvm += some / 3

    asked = pairs >= 2
    acf = moved[asked] / (np.add.reduceat(rank * rank, starts)[np.nonzero(asked)[0], None])
    spread = np.ptp(acf, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        acf -= acf.mean(axis=1, keepdims=True)
        acf /= np.sqrt(np.einsum("ij,ij->i", acf, acf) / n)[:, None]
    out, row = [], 0
    for j in range(len(starts)):
        z, clear = acf[row : row + asked[j].sum()], spread[row : row + asked[j].sum()] > 1e-12
        row += len(z)
        c5, c6 = (np.abs(z).max(axis=0), np.einsum("ij,ij->j", z, z)) if len(z) and clear.all() else (np.full(n, np.nan), np.full(n, np.nan))
        runs = slice(at[j], at[j + 1] if j + 1 < len(at) else len(first))
        out.append((len(count[runs]), np.full(n, events[runs].sum(), np.int64), {"c1": c1[j], "c2": c2[j], "cvm": cvm[j], "c5": c5, "c6": c6}))
    return out


def cells_at_once(gaps: DataFrame, seed: int, work, columns: str) -> DataFrame:
    """``work`` over the first gap of each cell and the arrays (segment, x, tau, hash) of a record's cells, in order; of each cell it gives a list for each of ``columns``."""
    kinds = {c.split()[0]: {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("label", "side", "segment", "i")])
        names = [group.column(k).to_numpy(zero_copy_only=False) for k in ("label", "side")]
        arrays = [group.column(k).to_numpy() for k in ("segment", "x", "tau", "_hash")]
        starts = np.flatnonzero(np.r_[True, (names[0][1:] != names[0][:-1]) | (names[1][1:] != names[1][:-1])])
        at, out = [], {k: [] for k in kinds}
        for start, got in zip(starts, work(starts, *arrays), strict=True):
            at += [start] * len(got[0])
            for k, v in zip(kinds, got, strict=True):
                out[k].extend(v)
        same = group.select(CELL).take(pa.array(at, pa.int64())) if at else group.select(CELL).slice(0, 0)
        for k, v in out.items():
            if kinds[k] == pa.float64():
                v = np.array(v, float)
                column = pa.array(v, pa.float64(), mask=~np.isfinite(v))
            else:
                column = pa.array(v, kinds[k])
            same = same.append_column(k, column)
        return same

    cell = ", ".join(f"{k} {gaps.schema[k].dataType.simpleString()}" for k in CELL)
    rows = gaps.select(*CELL, F.col("segment").cast("long").alias("segment"), F.col("i").cast("long").alias("i"), "x", "tau", gap_hash(seed).alias("_hash"))
    return deal.by_key(rows, "record").groupBy("record").applyInArrow(run, f"{cell}, {columns}")


def _by_cell(gaps: DataFrame, n_draws: int, seed: int, max_lag: int, work, columns: str) -> DataFrame:
    """``work`` over what ``_cell_arrays`` gives of each cell; it returns a list for each of ``columns``. A record's cells come to Python together, and are shuffled together, ``TOGETHER`` gaps at a time."""
    factors = draw_factors(n_draws, seed)

    def run(starts: np.ndarray, *arrays: np.ndarray) -> Iterator[list]:
        ends, low = np.r_[starts[1:], len(arrays[0])], 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + TOGETHER, "right")))
            some = slice(starts[low], ends[high - 1])
            for cell in _several_cells(starts[low:high] - starts[low], *(v[some] for v in arrays), factors, max_lag):
                yield work(*cell)
            low = high

    return cells_at_once(gaps, seed, run, columns)


def battery(gaps: DataFrame, n_draws: int, seed: int, max_lag: int = 5) -> DataFrame:
    """All statistics of every draw (b = 0 is the order as observed), a cell's arrays at a time: one exchange by record, B + 1 rows a cell out.

    The orders are those of ``draws``, and the statistics those of ``trend_statistics`` and ``dependence_statistics``.
    """

    def run(runs: int, events: np.ndarray, of: dict[str, np.ndarray]) -> list:
        return [range(len(events)), [runs] * len(events), events, *of.values()]

    return _by_cell(gaps, n_draws, seed, max_lag, run, "b long, n_segments long, n_events long, c1 double, c2 double, cvm double, c5 double, c6 double")


def at_or_above(s: np.ndarray) -> np.ndarray:
    """Of each value of a series, how many are as large or larger."""
    return len(s) - np.searchsorted(np.sort(s), s, "left")


def as_low(members: list[np.ndarray], k: int) -> float:
    """The share of draws whose least p over the members is k / n or lower, a member's p the share of its n draws as large or larger: those in which a member exceeds
    its (k + 1)-th largest value, so one partition a member tells."""
    n = len(members[0])
    if k == n:
        return 1.0
    low = np.zeros(n, bool)
    for s in members:
        low |= s > np.partition(s, n - 1 - k)[n - 1 - k]
    return np.count_nonzero(low) / n


def cell_tests(gaps: DataFrame, n_draws: int, seed: int, groups: dict[str, tuple[str, ...]], max_lag: int = 5) -> DataFrame:
    """The battery, judged where the draws are: cell, check, grp, statistic, p, n_members, null_p; one row a check that has a value, one a group (``check`` its name).

    A check's p is (1 + draws as large) / (1 + draws). A group's p is single-step min-P over its members defined in all draws: the share of draws whose least
    member p is as small as the observed one, from the same draws. ``null_p`` is the same question asked of draw 1 in place of the observed order:
    uniform if the check holds its size. Statistics are rounded to nine digits, so equal ones tie in every engine.
    """

    def run(_: int, __: np.ndarray, of: dict[str, np.ndarray]) -> list:
        of = {k: np.round(np.abs(v) if k == "c1" else v, 9) for k, v in of.items()}
        out: list[tuple] = []
        with np.errstate(invalid="ignore"):
            above = {k: [np.count_nonzero(s >= s[b]) for b in (0, 1)] for k, s in of.items()}
        for name, members in groups.items():
            for m in members:
                s = of[m]
                if np.isfinite(s[0]):
                    out.append((m, name, s[0], above[m][0] / len(s), 1, above[m][1] / len(s) if np.isfinite(s[1]) else np.nan))
            if some := [m for m in members if np.isfinite(of[m]).all()]:
                n, (seen, null) = len(of[some[0]]), (min(above[m][b] for m in some) for b in (0, 1))
                out.append((name, name, seen / n, as_low([of[m] for m in some], seen), len(some), as_low([of[m] for m in some], null)))
        return [[r[i] for r in out] for i in range(6)]

    return _by_cell(gaps, n_draws, seed, max_lag, run, "check string, grp string, statistic double, p double, n_members long, null_p double")


def bench_sizes(tests: DataFrame, ties: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How often each check rejects shuffled gaps, by the number of gaps: check, n_bench, rate, replicates. This is the bench of the ledger: cells of the tables themselves,
    their order shuffled once."""
    rows = tests.filter("null_p is not null").join(ties.select(*CELL, "n"), list(CELL))
    return rows.groupBy("check", F.col("n").alias("n_bench")).agg(F.avg((F.col("null_p") <= alpha).cast("double")).alias("rate"), F.count("*").alias("replicates"))


def battery_p_values(stats: DataFrame) -> DataFrame:
    return p_values(long_statistics(stats, TREND + DEPENDENCE))


def min_p(statistics: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Single-step min-P of groups of checks: every draw's least p over a group's members, and the share of draws at or below the observed one."""
    w = Window.partitionBy(*CELL, "check")
    of = F.create_map(*[F.lit(x) for name, members in groups.items() for m in members for x in (m, name)])
    rows = long_statistics(statistics, tuple(m for members in groups.values() for m in members)).withColumn("grp", of[F.col("check")])
    rows = rows.withColumn("defined", F.count("s").over(w) == F.count("*").over(w)).filter("defined")
    # draws at or above s: those whose rank in descending order, ties at the end of their run, is that many
    p = F.count("*").over(w.orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, 0)) / F.count("*").over(w)
    least = rows.withColumn("p", p).groupBy(*CELL, "grp", "b").agg(F.min("p").alias("least"), F.count("*").alias("n_members"))
    seen = least.withColumn("seen", F.max(F.when(F.col("b") == 0, F.col("least"))).over(Window.partitionBy(*CELL, "grp")))
    return seen.groupBy(*CELL, "grp").agg(F.first("n_members").alias("n_members"), (F.count_if(F.col("least") <= F.col("seen") + 1e-12) / F.count("*")).alias("p"))


def tie_statistics(gaps: DataFrame) -> DataFrame:
    """Distinct gaps and the share of gaps that repeat, per cell."""
    w = Window.partitionBy(*CELL, "x")
    return gaps.withColumn("k", F.count("*").over(w)).groupBy(*CELL).agg(F.count("*").alias("n"), F.count_distinct("x").alias("n_distinct"), F.avg((F.col("k") > 1).cast("double")).alias("tied"))


def verdict(p: Column, check: Column, n_events: Column, n_distinct: Column, bench: Column, alpha: float = 0.05, least: int = 20, cutoff: int = 5) -> Column:
    """not computed, ties, fail, inconclusive, pass: the first that applies."""
    return (
        F.when(p.isNull(), "not computed").when(check.isin(*TIE_SENSITIVE) & (n_distinct < cutoff), "ties").when(p <= alpha, "fail").when((n_events < least) | ~F.coalesce(bench, F.lit(False)), "inconclusive").otherwise("pass")
    )


def ledger(cells: DataFrame, scored: DataFrame, ties: DataFrame, checks: tuple[str, ...], bench: DataFrame | None = None, groups: tuple[str, ...] = (), **rule) -> DataFrame:
    """A row for every cell and check asked, answered or not, and one for every group of checks. bench: check, n_bench, accepted; a cell reads the nearest n, the smaller on a
    tie. A group's size comes from the permutation argument and asks no bench. Rows without a p have a reason."""
    spark = cells.sparkSession
    names = spark.createDataFrame([(c,) for c in checks + groups], "check string")
    rows = cells.select(*CELL).distinct().crossJoin(F.broadcast(names)).join(scored.select(*CELL, "check", "statistic", "p"), [*CELL, "check"], "left").join(ties, CELL, "left")
    if bench is None:
        rows = rows.withColumn("accepted", F.lit(None).cast("boolean"))
    else:
        rows = nearest_bench(rows, bench)
    rows = rows.withColumn("accepted", F.col("accepted") | F.col("check").isin(*groups) if groups else F.col("accepted"))
    why = F.when(F.col("p").isNotNull(), "").when(F.col("n").isNull(), "no usable segment").when(F.col("check").isin(*TIE_SENSITIVE), "a lag has no spread or too few pairs").otherwise("no event is read")
    return rows.withColumn("verdict", verdict(F.col("p"), F.col("check"), F.coalesce("n", F.lit(0)), F.coalesce("n_distinct", F.lit(0)), F.col("accepted"), **rule)).withColumn("reason", why)


def nearest_bench(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Adds ``accepted`` from the bench row of the nearest event count, the smaller on a tie. A bench has a row for each check and event count; its grid per check is gathered into one array."""
    grid = bench.groupBy("check").agg(F.collect_list(F.struct("n_bench", "accepted")).alias("grid"))
    met = rows.join(F.broadcast(grid), "check", "left")
    near = F.array_min(F.transform("grid", lambda g: F.struct(F.abs(g["n_bench"] - F.coalesce("n", F.lit(0))).alias("gap"), g["n_bench"].alias("n_bench"), g["accepted"].alias("accepted"))))
    return met.withColumn("accepted", near["accepted"]).drop("grid")


def bench_bound(null_cells: int) -> float:
    """The largest |z| that a check of nominal size shows over all null cells, with 95 % confidence (Bonferroni)."""
    return normal_quantile(1 - 0.05 / (2 * max(1, null_cells)))


def bench_acceptance(size: DataFrame, alpha: float, null_cells: int) -> DataFrame:
    """size: check, n_bench, rate, replicates per null cell -> the worst |z| per check and n against a Bonferroni bound over the null cells."""
    z = (F.col("rate") - alpha) / F.sqrt(alpha * (1 - alpha) / F.col("replicates"))
    return size.withColumn("z", z).groupBy("check", "n_bench").agg(F.max_by("z", F.abs("z")).alias("worst_z"), F.count("*").alias("n_cells")).withColumn("accepted", F.abs("worst_z") <= bench_bound(null_cells))


def outcome_grid(rows: DataFrame, checks: list[str]) -> DataFrame:
    """Cells in rows, checks in columns, verdicts inside."""
    return rows.groupBy(*CELL).pivot("check", checks).agg(F.first("verdict"))


def attachments(rows: DataFrame) -> DataFrame:
    """What travels with an estimate of a cell: the checks asked, those unanswered, and the verdicts."""
    return rows.groupBy(*CELL).agg(F.array_sort(F.collect_list("check")).alias("asked"), F.array_sort(F.collect_list(F.when(F.col("verdict") == "not computed", F.col("check")))).alias("unanswered"), F.array_sort(F.collect_list(F.concat("check", F.lit("="), "verdict"))).alias("verdicts"))
