"""The serial copula test: published values, several segments, blocks."""

from __future__ import annotations

import os

import numpy as np
import pytest

from tidespan import registry
from tidespan.operators import copula, renewal

#: Statistic and p of three exponential series at lag 5, as the published implementation of the test gives them.
PUBLISHED = {50: (0.0057908, 0.9575), 150: (0.0071326, 0.9036), 355: (0.0076331, 0.8656)}


def frame(spark, cells):
    rows = [(k, "r", "s", s, i + 1, float(v), 1e9) for k, segments in cells.items() for s, xs in enumerate(segments) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double")


def test_published_values(spark):
    rng = np.random.default_rng(0)
    got = {r.record: r for r in copula.serial_independence(frame(spark, {n: [rng.exponential(1.0, n)] for n in PUBLISHED})).collect()}
    for n, (statistic, p) in PUBLISHED.items():
        assert round(got[n].statistic, 7) == statistic and abs(got[n].p - p) < 0.03 and got[n].n_vectors == n - 5


def test_dependence_segments_and_size(spark):
    rng = np.random.default_rng(3)
    walk = np.exp(np.cumsum(rng.normal(size=500)) / 5)
    cells = {1: [walk], 2: [walk[:40], walk[40:90], walk[90:94]], 3: [rng.random(450)], 4: [[1.0, 2, 3, 4, 5, 6]], 5: [np.ones(30)], 6: [rng.random(7)]}
    got = {r.record: r for r in copula.serial_independence(frame(spark, cells), n_null=200).collect()}
    assert got[1].p < 0.01 and got[2].p < 0.05 and got[2].n_vectors == 35 + 45 and got[2].n_segments == 3 and got[3].p > 0.01
    assert {k: got[k].reason for k in got} == {1: "", 2: "", 3: "", 4: "fewer than two vectors", 5: "all gaps are equal", 6: ""}


def test_blocks_change_nothing(monkeypatch):
    u = np.random.default_rng(4).random((3, 40, 4))
    want = copula.distances(u)
    direct = []
    for v in u:
        j = 1 - np.maximum(v[:, None], v[None])
        k = j.mean(axis=1)
        direct.append(j.prod(axis=2).sum() / 40 - 2 * k.prod(axis=1).sum() + 40 * k.mean(axis=0).prod())
    monkeypatch.setattr(copula, "BLOCK", 500)
    assert np.allclose(want, direct) and np.allclose(copula.distances(u), direct)


def test_shuffles_are_those_of_the_battery(spark):
    gaps = frame(spark, {1: [np.random.default_rng(5).random(9), np.random.default_rng(6).random(8)]})
    factors = renewal.draw_factors(3, 7)
    rows = gaps.withColumn("_hash", renewal.gap_hash(7)).orderBy("segment", "i").collect()
    x, segment, h = (np.array([r[c] for r in rows]) for c in ("x", "segment", "_hash"))
    u = np.concatenate(list(copula._blocks(x, segment, h, factors, 1)))
    drawn = {}
    for r in renewal.draws(gaps, 3, 7).orderBy("b", "segment", "pos").collect():
        drawn.setdefault(r.b, []).append(r.x)
    for b, xs in drawn.items():
        ranks = np.array([(x <= v).sum() for v in xs]) / len(x)
        assert np.allclose(u[b][:, 0], np.r_[ranks[:8], ranks[9:16]])


def test_cells_of_a_record_stand_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(1, label, side, s, i + 1, float(v), 1e9) for label in "ab" for side in ("in", "out") for s in (3, 5) for i, v in enumerate(rng.random(9))]
    gaps = spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double")
    got = {(r.label, r.side): r for r in copula.serial_independence(gaps, n_null=50).collect()}
    assert len(got) == 4 and len({r.statistic for r in got.values()}) == 4
    for (label, side), r in got.items():
        assert (r.n, r.n_vectors, r.n_segments, r.reason) == (18, 8, 2, "") and r == copula.serial_independence(gaps.filter(f"label = '{label}' and side = '{side}'"), n_null=50).first()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_statistics_that_end_in_a_five_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (117, 537)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = {r[:3]: r[7] for r in con.execute(registry.oracle_sql()["c3"]).fetchall()}
    got = {(r.record, r.label, r.side): r.statistic for r in registry.queries()["c3"](spark, str(tmp_path)).collect()}
    assert got == want and got[537, "r20", "out_of_spec"] == 0.0037508 and got[117, "r20", "out_of_spec"] == 0.0006562


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_odd_reads_give_the_rows_of_the_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 23 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 31 = 0 THEN date_trunc('day', ts) WHEN event_id % 89 <> 0 THEN ts END AS ts,
      CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 'nan'::DOUBLE WHEN event_id % 73 = 0 THEN 'inf'::DOUBLE WHEN event_id % 71 = 0 THEN -value ELSE value END AS value)
      FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = {r[:3]: r for r in con.execute(registry.oracle_sql()["c3"]).fetchall()}
    got = {tuple(r)[:3]: tuple(r) for r in registry.queries()["c3"](spark, str(tmp_path)).collect()}
    assert got == want and len({r[-1] for r in want.values()}) == 2
