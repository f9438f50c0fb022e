"""The carve for records too long for one task: the same rows as ``carve``, cut into pieces of time that run in parallel.

A record of more than ``piece_reads`` reads is cut into even slices of its span, 64 for every ``piece_reads`` reads, so that bursts spread too; shorter records are one
piece. What a window over the whole record would look at beyond its piece is little: the last read before it, the first one after it, and how many
gaps or changes of side came before. Each is an aggregate of a piece, so a window over piece summaries (64 rows for every ``piece_reads`` reads)
carries it along the record, and a window over each piece, its summary put before its reads, brings it to them. Values of a whole record, such as the gap threshold, travel the same
way, so nothing is ever joined or windowed on the record alone. The median step comes from counts of equal steps and their running totals.

Each pass reads its input twice, once for the summaries and once for the reads. ``keep`` stores what a pass gives, so that the next one starts from there and the work
stays linear in the passes (four): ``stored`` checkpoints in the folder that the session names in spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidespan.operators.carve import IN, OUT, finite, is_confident, is_in_spec, margin
from tidespan.operators.prefix import running

#: Reads in a piece, about; and slices of a long record for every so many.
PIECE_READS, SLICES = 1_000_000, 64
#: Long records up to which their spans are broadcast (some 40 bytes each); a shuffled join serves beyond.
BROADCAST_RECORDS = 500_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed where the session names a folder for that, else as it is."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return df.checkpoint() if named else df


def cut(reads: DataFrame, piece_reads: int = PIECE_READS) -> DataFrame:
    """``reads`` with ``piece``: 0 in short records, the slice of the span in long ones."""
    spans = reads.groupBy("record").agg(F.min("t_us").alias("_t0"), (F.max("t_us") - F.min("t_us") + 1).alias("_span"), F.count("*").alias("_n")).filter(F.col("_n") > piece_reads)
    pieces = spans.select(F.col("record").alias("_record"), "_t0", "_span", (SLICES * F.ceil(F.col("_n") / piece_reads)).alias("_pieces"))
    few = F.broadcast(pieces) if pieces.count() <= BROADCAST_RECORDS else pieces
    at = F.floor((F.col("t_us") - F.col("_t0")) / F.col("_span") * F.col("_pieces"))
    return reads.join(few, F.col("record").eqNullSafe(F.col("_record")), "left").withColumn("piece", F.coalesce(at, F.lit(0))).drop("_record", "_t0", "_span", "_pieces")


def carried(rows: DataFrame, key: Sequence[str], lag: Mapping[str, Column] = {}, lead: Mapping[str, Column] = {}, total: Mapping[str, Column] = {}, whole: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``piece``, ordered by t_us and seq) with the value of the read before (``lag``) or after (``lead``) and running totals up to the read (``total``), along the key
    whatever the pieces; and the columns of ``whole``, a row a key."""
    time = F.struct("t_us", "seq")
    ends = [F.max_by(F.struct(F.lit(True), *[c.alias(n) for n, c in lag.items()]), time).alias("_last"), F.min_by(F.struct(F.lit(True), *[c.alias(n) for n, c in lead.items()]), time).alias("_first")]
    parts = rows.groupBy(*key, "piece").agg(*ends, *[F.sum(c).alias(f"_t_{n}") for n, c in total.items()])
    along = Window.partitionBy(*key).orderBy("piece")
    before = [F.coalesce(F.sum(f"_t_{n}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_t_{n}") for n in total]
    parts = parts.select(*key, "piece", F.lag("_last").over(along).alias("_last"), F.lead("_first").over(along).alias("_first"), *before)
    extra = []
    if whole is not None:
        parts, extra = _joined(parts, whole, key, "left"), [c for c in whole.columns if c not in key]
    # a summary stands before its piece's reads, so that one sort carries it to them
    own = {f"_l_{n}": c for n, c in lag.items()} | {f"_r_{n}": c for n, c in lead.items()} | {f"_s_{n}": c for n, c in total.items()}
    local = rows.select("*", *[c.alias(n) for n, c in own.items()], F.lit(1).alias("_read"))
    carry = [F.col("_last")[n].alias(f"_l_{n}") for n in lag] + [F.col(f"_t_{n}").alias(f"_s_{n}") for n in total] + [F.col("_first")[n].alias(f"_f_{n}") for n in lead]
    both = local.unionByName(parts.select(*key, "piece", *carry, *[F.col(c).alias(f"_w_{c}") for c in extra], F.lit(0).alias("_read")), allowMissingColumns=True)
    here = Window.partitionBy(*key, "piece").orderBy("_read", "t_us", "seq")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.lag(f"_l_{n}").over(here) for n in lag}
    out |= {n: F.when(F.lead("_read").over(here).isNotNull(), F.lead(f"_r_{n}").over(here)).otherwise(F.first(f"_f_{n}").over(so_far)) for n in lead}
    out |= {n: F.sum(f"_s_{n}").over(so_far) for n in total} | {c: F.first(f"_w_{c}").over(so_far) for c in extra}
    given = [c for c in rows.columns if c not in out]
    return both.select(*given, "_read", *[c.alias(n) for n, c in out.items()]).filter("_read = 1").select(*given, *out)


def _joined(a: DataFrame, b: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """A join that finds null keys too."""
    other = b.withColumnsRenamed({c: f"_j_{c}" for c in key})
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return a.join(other, on, how).drop(*[f"_j_{c}" for c in key])


def median_step(steps: DataFrame) -> DataFrame:
    """steps: record, dt_us -> record, median_us: the median of the positive steps, from counts of equal ones; no row without a positive step."""
    counts = steps.filter("dt_us > 0").groupBy("record", "dt_us").agg(F.count("*").alias("c"))
    size = counts.groupBy("record").agg(F.sum("c").alias("n"))
    up = running(counts, ["record"], "dt_us", {"k": (F.col("c"), "sum")})
    # the two middle steps: the first by which n / 2 are reached, and the first by which n / 2 are exceeded (the same where n is odd)
    met = _joined(up, size, ["record"], "inner").groupBy("record").agg(F.min(F.when(2 * F.col("k") >= F.col("n"), F.col("dt_us"))).alias("a"), F.min(F.when(2 * F.col("k") >= F.col("n") + 2 - F.col("n") % 2, F.col("dt_us"))).alias("b"))
    return met.select("record", ((F.col("a") + F.col("b")) / 2).alias("median_us"))


def observed_reads(reads: DataFrame, gap_mult: float = 10.0, piece_reads: int = PIECE_READS, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """As ``carve.observed_reads``, with ``piece``."""
    if not gap_mult > 0:
        raise ValueError("gap_mult must be positive")
    clean = reads.filter(F.col("t_us").isNotNull() & finite("value")).withColumn("sigma", F.when(finite("sigma"), F.col("sigma")))
    rows = carried(cut(clean, piece_reads), ["record"], lag={"_before": F.col("t_us")})
    rows = keep(rows.withColumn("dt_us", F.col("t_us") - F.col("_before")).drop("_before"))
    size = rows.groupBy("record").agg(F.count("*").alias("n"))
    whole = _joined(size, median_step(rows.select("record", "dt_us")), ["record"], "left").select("record", (gap_mult * F.col("median_us")).alias("gap_us"), "n")
    rows = keep(carried(rows, ["record"], whole=whole).withColumn("is_gap", F.coalesce(F.col("dt_us") > F.col("gap_us"), F.lit(False))))
    return keep(carried(rows, ["record"], total={"segment": F.col("is_gap").cast("long")}))


def threshold_reads(obs: DataFrame, ladder: DataFrame, k: float = 1.0, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """As ``carve.threshold_reads``, of reads with ``piece``."""
    if not k > 0:
        raise ValueError("k must be positive")
    lags = {"prev_us": F.col("t_us"), "_value": F.col("value"), "_some": F.lit(True)}
    rows = keep(carried(obs.filter("n >= 2"), ["record"], lag=lags, lead={"next_us": F.col("t_us"), "next_gap": F.col("is_gap")}, total={"rn": F.lit(1)}))
    rungs = ladder.collect()  # a literal of the caller; a read's windows on all rungs are counted in its one row
    of = lambda x, threshold, big_is_good: is_in_spec(margin(F.col(x), threshold, big_is_good))
    before = lambda *rung: F.when(F.col("_some"), of("_value", *rung))
    starts = lambda *rung: before(*rung).isNull() | F.col("is_gap") | (of("value", *rung) != before(*rung))
    rows = carried(rows, ["record"], total={f"_island{i}": starts(F.lit(g["threshold"]), F.lit(g["big_is_good"])).cast("long") for i, g in enumerate(rungs)})
    at = F.array(*[F.struct(*[F.lit(g[c]).cast(ladder.schema[c].dataType).alias(c) for c in ladder.columns], F.col(f"_island{i}").alias("island")) for i, g in enumerate(rungs)])
    if not rungs:
        at = F.array().cast(T.ArrayType(T.StructType([*ladder.schema, T.StructField("island", T.LongType())])))
    rows = rows.select(*[c for c in rows.columns if not c.startswith("_island")], F.inline(at))
    rows = rows.withColumn("margin", margin(F.col("value"), F.col("threshold"), F.col("big_is_good")))
    rows = rows.withColumn("in_spec", is_in_spec(F.col("margin"))).withColumn("confident", is_confident(F.col("margin"), F.col("sigma"), k))
    rows = rows.withColumn("state", F.concat(F.when(F.col("in_spec"), IN).otherwise(OUT), F.when(F.col("confident"), "").otherwise("_uncertain")))
    rung = F.col("threshold"), F.col("big_is_good")
    return rows.withColumn("prev_in", before(*rung)).withColumn("starts", starts(*rung)).drop("_value", "_some")
