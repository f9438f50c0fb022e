"""Records cut into pieces give the rows of records in one task."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidespan.operators import carve, long_records
from tidespan.operators.carve import Rung


def reads(spark, seed):
    rng, rows = random.Random(seed), []
    for record in (1, 2, 3, 4, 5, None):
        t = rng.randrange(10**12)
        for i in range({3: 1, 4: 2}.get(record, rng.randint(20, 90))):
            t += rng.choice([0, 1, 1_000, 1_000, 900, 1_100, 200_000 if record != 2 else 5])
            value = rng.choice([5.0, 20.0, 50.0, 120.0, None, float("nan")]) if rng.random() < 0.3 else rng.random() * 100
            rows.append((record, t, i, value, rng.choice([None, 3.0, 10.0])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "record long, t_us long, seq long, value double, sigma double").withColumn("extra", F.lit("x"))


@pytest.mark.parametrize(("seed", "piece_reads"), [(1, 1), (2, 7), (3, 30), (4, 10**9)])
def test_equal_to_the_carve_in_one_task(spark, seed, piece_reads):
    df, ladder = reads(spark, seed), carve.ladder_frame(spark, [Rung("a", 20.0), Rung("b", 50.0, False)])
    one = carve.observed_reads(df, 4.0)
    many = long_records.observed_reads(df, 4.0, piece_reads)  # checkpointed, as the session names a folder
    assert set(many.columns) == {*one.columns, "piece"}
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    assert same(one, many)
    assert many.select("record", "piece").distinct().count() > 12 or piece_reads > 30
    rows, cut = carve.threshold_reads(one, ladder), long_records.threshold_reads(many, ladder)
    assert same(rows, cut)
    assert same(carve.windows(rows), carve.windows(cut))


def test_median_of_steps(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, d) for k in range(30) for d in [rng.choice([0, -1, 5, 6, 7, 100, 10**9]) for _ in range(rng.randint(1, 12))]], "record long, dt_us long")
    want = {r.record: r.m for r in df.groupBy("record").agg(F.median(F.when(F.col("dt_us") > 0, F.col("dt_us"))).alias("m")).collect() if r.m is not None}
    assert {r.record: r.median_us for r in long_records.median_step(df).collect()} == want


def test_no_window_holds_a_record(spark):
    """Every window over reads is of one piece; those over a whole record see piece summaries, or counts of equal steps in pieces."""
    plain = lambda df: df
    df = long_records.threshold_reads(long_records.observed_reads(reads(spark, 6), 4.0, 5, plain), carve.ladder_frame(spark, [Rung("a", 20.0)]), keep=plain)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[(.*)\], \[(.*?)\], \[(.*?)\]", plan)
    assert len(windows) > 5
    assert all("piece" in keys + order for _, keys, order in windows), windows


def test_reads_are_windowed_once_for_all_rungs(spark):
    """The windows of all rungs are counted in a read's one row, and a piece's summary comes to its reads by the sort they have anyway: no join, no window by rung."""
    plain = lambda df: df
    obs = carve.observed_reads(reads(spark, 7), 4.0).withColumn("piece", F.floor(F.col("t_us") / 100_000))
    rungs = [Rung("a", 20.0), Rung("b", 50.0, False), Rung("c", 0.0)]
    df = long_records.threshold_reads(obs, carve.ladder_frame(spark, rungs), keep=plain)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "label" not in "".join(keys for _, keys, _ in re.findall(r"Window \[(.*)\], \[(.*?)\], \[(.*?)\]", plan)) and "Join" not in plan, plan
    columns = ("record", "label", "seq", "island", "rn", "prev_us", "prev_in", "next_us", "next_gap", "starts", "state")
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(df) == rows(carve.threshold_reads(obs, carve.ladder_frame(spark, rungs)))
    assert long_records.threshold_reads(obs, carve.ladder_frame(spark, rungs).limit(0), keep=plain).isEmpty()
