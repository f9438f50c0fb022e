"""Cycles on two clocks, a row of figures a device, and devices side by side."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidespan.operators import cycle_panels, renewal

GROUPS = {"trend": renewal.TREND, "dependence": renewal.DEPENDENCE}


@pytest.fixture(scope="module")
def table(spark):
    """Device 1: stretches of 3 and 2 cycles, the second ended by a complete one; device 2: one censored cycle; device 3: twenty growing cycles."""
    rows, at = [], 0
    for record, stretch, lengths, tail in ((1, 0, [10.0, 20.0], 5.0), (1, 1, [30.0, 10.0], None), (2, 0, [], 7.0), (3, 0, [float(k) for k in range(1, 21)], 4.0)):
        for k, x in enumerate([*lengths, *([tail] if tail else [])]):
            rows.append((record, stretch, at, at + int(x * 1e6), k < len(lengths), x))
            at += int(x * 1e6) + 1
    return spark.createDataFrame(rows, "record long, stretch long, start_us long, end_us long, event boolean, length_s double")


def test_both_clocks(spark, table):
    got = {}
    for r in cycle_panels.clock_gaps(table).orderBy("record", "side", "segment", "i").collect():
        got.setdefault((r.record, r.side, r.segment), []).append((r.i, r.x, r.tau))
    assert got[1, "within_stretch", 0] == [(1, 10.0, 35.0), (2, 20.0, 35.0)] and got[1, "within_stretch", 1] == [(1, 30.0, 40.0), (2, 10.0, 40.0)]
    assert got[1, "end_to_end", 0] == [(1, 10.0, 70.0), (2, 20.0, 70.0), (3, 30.0, 70.0), (4, 10.0, 70.0)]  # the last cycle is complete: no residual
    assert got[3, "end_to_end", 0][0] == (1, 1.0, 214.0) and not any(k[0] == 2 for k in got)


def test_checks_answer_where_they_can(spark, table):
    rows = {(r.record, r.side, r.check): r for r in cycle_panels.checks(table, 99, 3, GROUPS, 100, least=8).collect()}
    assert len(rows) == 3 * 2 * 7
    assert rows[3, "within_stretch", "c1"].p <= 0.02 and rows[3, "end_to_end", "trend"].verdict == "fail"
    assert rows[2, "end_to_end", "c1"].verdict == "not computed" and rows[2, "end_to_end", "c1"].reason == "no usable segment"
    assert rows[1, "within_stretch", "c1"].reason == "no usable segment" and rows[1, "end_to_end", "c1"].p is not None


def test_panel_and_pairs(spark, table):
    ledger = cycle_panels.checks(table, 99, 3, GROUPS, 100, least=8)
    live = spark.createDataFrame([(k, 0) for k in (1, 2, 3, 4)], "record long, stretch long")
    dropped = live.groupBy("record").agg(F.count("*").alias("n_stretches"), F.lit(0).cast("long").alias("n_dropped"), F.lit(0).cast("long").alias("n_merged"))
    rows = {r.record: r for r in cycle_panels.panel(table, live, dropped, ledger).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and (rows[1].n_complete, rows[1].n_censored, rows[4].n_complete, rows[4].mtbc_s) == (4, 1, 0, None)
    # device 1: 5 censored, then 10, 10, 20, 30 complete -> survival 1, 1/2, 1/4, 0
    assert math.isclose(rows[1].mtbc_s, 10 + 10 / 2 + 10 / 4) and rows[2].mtbc_s == 7.0 and "trend=fail" in rows[3].within_stretch
    pairs = spark.createDataFrame([(1, 3), (1, 2), (1, 4)], "first long, second long")
    got = {(r.first, r.second): r for r in cycle_panels.compare(table, pairs, ledger).collect()}
    assert sorted(got) == [(1, 2), (1, 3)] and got[1, 3].tau == 20.0 and got[1, 2].tau == 7.0
    assert math.isclose(got[1, 3].mean_a, 15.0) and math.isclose(got[1, 3].difference, got[1, 3].mean_a - got[1, 3].mean_b) and got[1, 2].difference == 0
    assert got[1, 3].verdicts_b == rows[3].within_stretch and got[1, 3].se_b > 0


@pytest.mark.parametrize("name", ["cycle_panel", "cycle_checks", "cycle_comparison"])
def test_a_task_holds_few_sorts(spark, name):
    """Spells and cycles stand computed when the tables are judged, so that no stage works them out again beside its own sorts."""
    from tidespan import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "Relation [" not in plan and plan.count("Window [") <= 10, plan


def test_a_comparison_asks_for_means_and_verdicts_once(spark, table):
    ledger = renewal.ledger(table.select("record", F.lit("cycles").alias("label"), F.explode(F.array(F.lit("within_stretch"), F.lit("end_to_end"))).alias("side")), spark.createDataFrame([], "record long, label string, side string, check string, statistic double, p double"), spark.createDataFrame([], "record long, label string, side string, n long, n_distinct long, tied double"), ("c1",))
    out = cycle_panels.compare(table, spark.createDataFrame([(1, 3), (3, 1)], "first long, second long"), ledger)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1, plan
    rows = {(r.first, r.second): r for r in out.collect()}
    assert rows[1, 3].mean_a == rows[3, 1].mean_b and rows[1, 3].difference == -rows[3, 1].difference and rows[1, 3].verdicts_a == rows[3, 1].verdicts_b == "c1=not computed"
