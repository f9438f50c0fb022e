"""Carving against hand records and against a loop."""

from __future__ import annotations

import random

import pytest

from tidespan.operators import carve
from tidespan.operators.carve import Rung


def reads(spark, rows, record=1):
    data = [(record, int(t * 1e6), i, None if v is None else float(v), s) for i, (t, v, *rest) in enumerate(rows) for s in [rest[0] if rest else None]]
    return spark.createDataFrame(data, "record long, t_us long, seq long, value double, sigma double")


def run(spark, rows, rung=5.0, big=True, mult=10.0, k=1.0):
    obs = carve.observed_reads(reads(spark, rows), mult)
    marked = carve.threshold_reads(obs, carve.ladder_frame(spark, [Rung("r", rung, big)]), k)
    return obs, marked, carve.windows(marked)


def test_gap_beats_crossing(spark):
    _, rows, wins = run(spark, [(0, 6), (1, 6), (2, 6), (3, 6), (100, 1)])
    w = {r.side: r for r in wins.collect()}
    assert w["in_spec"].death_kind == "gap_start" and w["in_spec"].duration_s == 3.0 and w["in_spec"].censored
    assert w["out_of_spec"].birth_kind == "gap_resume" and carve.tiling_errors(rows, wins).isEmpty()


@pytest.mark.parametrize("big", [True, False])
def test_value_at_the_rung_is_in_spec(spark, big):
    _, rows, _ = run(spark, [(0, 5), (1, 5)], big=big)
    assert all(r.in_spec for r in rows.collect())


def test_spacing_of_exactly_ten_medians_is_no_gap(spark):
    obs, _, _ = run(spark, [(0, 6), (1, 6), (2, 6), (3, 6), (13, 6)])
    assert not any(r.is_gap for r in obs.collect())


def test_repeated_times_do_not_count_for_the_median(spark):
    obs, _, _ = run(spark, [(2 * (i // 2), 6) for i in range(20)])
    s = carve.gap_stats(obs).first()
    assert (s.median_spacing_s, s.gap_threshold_s, s.n_repeated) == (2.0, 20.0, 10)


def test_non_finite_reads_go_before_spacing(spark):
    obs, _, wins = run(spark, [(0, 6), (1, 6), (2, float("nan")), (3, None), (12, 6), (13, 6), (14, 6)], mult=5.0)
    assert [r.is_gap for r in obs.orderBy("t_us").collect()] == [False, False, True, False, False] and wins.count() == 2


def test_unknown_sigma_is_uncertain(spark):
    _, rows, _ = run(spark, [(0, 9, 1.0), (1, 9, None), (2, 1, 10.0)])
    assert [r.state for r in rows.orderBy("t_us").collect()] == ["in_spec", "in_spec_uncertain", "out_of_spec_uncertain"]


def test_short_and_empty_records(spark):
    assert run(spark, [(0, 6)])[2].isEmpty() and run(spark, [])[2].isEmpty()


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        carve.ladder_frame(spark, [Rung("a", 1.0), Rung("a", 2.0)])
    with pytest.raises(ValueError):
        run(spark, [(0, 1), (1, 1)], k=0)
    with pytest.raises(ValueError):
        run(spark, [(0, 1), (1, 1)], mult=0)


def loop(rows, rung, mult):
    """Windows by a plain loop."""
    steps = sorted(b[0] - a[0] for a, b in zip(rows, rows[1:]) if b[0] > a[0])
    m = len(steps)
    gap = mult * (steps[m // 2] if m % 2 else (steps[m // 2 - 1] + steps[m // 2]) / 2) if m else float("inf")
    out, s = [], 0
    on = [v >= rung for _, v in rows]
    for e in range(1, len(rows) + 1):
        end = e == len(rows)
        cut = not end and rows[e][0] - rows[e - 1][0] > gap
        if end or cut or on[e] != on[s]:
            birth = "scan_start" if s == 0 else "gap_resume" if rows[s][0] - rows[s - 1][0] > gap else "crossing"
            death = "scan_end" if end else "gap_start" if cut else "crossing"
            last = rows[e][0] if death == "crossing" else rows[e - 1][0]
            out.append(("in_spec" if on[s] else "out_of_spec", rows[s][0] * 10**6, last * 10**6, birth, death, e - s))
            s = e
    return out


def test_random_records_agree_with_a_loop(spark):
    rng = random.Random(3)
    data, want = [], {}
    for record in range(40):
        t, rows = 0, []
        for _ in range(rng.randint(2, 40)):
            rows.append((t, rng.choice([1, 4, 5, 6, 9])))
            t += rng.choice([0, 1, 1, 1, 1, 2, 50])
        data += [(record, t * 10**6, i, float(v), None) for i, (t, v) in enumerate(rows)]
        want[record] = loop(rows, 5, 10)
    df = spark.createDataFrame(data, "record long, t_us long, seq long, value double, sigma double")
    rows = carve.threshold_reads(carve.observed_reads(df), carve.ladder_frame(spark, [Rung("r", 5.0)]))
    wins = carve.windows(rows)
    got = {}
    for r in wins.orderBy("record", "island").collect():
        got.setdefault(r.record, []).append((r.side, r.birth_us, r.death_us, r.birth_kind, r.death_kind, r.n_reads))
    assert got == want and carve.tiling_errors(rows, wins).isEmpty()


def test_mirrored_values_swap_the_sides(spark):
    rows = [(i, v) for i, v in enumerate([6, 7, 2, 3, 8, 1, 1])]
    a = {(r.side, r.birth_us, r.death_us) for r in run(spark, rows)[2].collect()}
    b = {(r.side, r.birth_us, r.death_us) for r in run(spark, [(t, 10.0 - v) for t, v in rows])[2].collect()}
    swap = {"in_spec": "out_of_spec", "out_of_spec": "in_spec"}
    assert {(swap[s], x, y) for s, x, y in a} == b


def test_gap_split_timeline(spark):
    spans = spark.createDataFrame([(1, "r", 0, 10, "a"), (1, "r", 10, 30, "b")], "record long, label string, start_us long, end_us long, state string")
    gaps = spark.createDataFrame([(1, 12, 20)], "record long, before_us long, after_us long")
    got = sorted((r.start_us, r.end_us, r.state) for r in carve.split_at_gaps(spans, gaps, "state").collect())
    assert got == [(0, 10, "a"), (10, 12, "b"), (12, 20, "unobserved"), (20, 30, "b")]
