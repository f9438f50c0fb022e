"""Cell tests against the long tables, the bench and group rows of the ledger, and the assumptions it speaks to."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.operators import assumptions, renewal

GROUPS = {"trend": renewal.TREND, "dependence": renewal.DEPENDENCE}


def make(spark, cells=6, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for record in range(cells):
        for segment in range(int(rng.integers(1, 4))):
            x = np.round(rng.exponential(size=int(rng.integers(3, 12))), 1) + 0.1
            rows += [(record, "r", "s", segment, i + 1, float(v), float(x.sum() + segment)) for i, v in enumerate(x)]
    return renewal.usable(spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double"))


def test_cell_tests_are_those_of_the_long_tables(spark):
    gaps = make(spark)
    stats = renewal.battery(gaps, 60, 4)
    want = {(r.record, r.check): (r.statistic, r.p) for r in renewal.battery_p_values(stats).collect()}
    want |= {(r.record, r.grp): (r.n_members, r.p) for r in renewal.min_p(stats, GROUPS).collect()}
    got = renewal.cell_tests(gaps, 60, 4, GROUPS).collect()
    assert {(r.record, r.check) for r in got} == set(want)
    for r in got:
        a, p = want[r.record, r.check]
        assert np.isclose(r.p, p) and np.isclose(a, r.n_members if r.check == r.grp else r.statistic)
        assert 1 / 61 - 1e-12 <= r.null_p <= 1


def test_null_p_is_uniform_and_accepted(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "r", "s", 0, i + 1, float(v), 99.0) for k in range(300) for i, v in enumerate(rng.exponential(size=12) * (1 + np.arange(12)))]
    gaps = renewal.usable(spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double"))
    tests = renewal.cell_tests(gaps, 99, 1, GROUPS)
    sizes = renewal.bench_sizes(tests.filter("check <> grp"), renewal.tie_statistics(gaps))
    assert {(r.check, r.replicates) for r in sizes.collect()} == {(c, 300) for c in renewal.TREND + renewal.DEPENDENCE}
    assert renewal.bench_acceptance(sizes, 0.05, 100).filter("not accepted").count() == 0
    assert tests.filter("check = 'c1' and p <= 0.05").count() > 100  # the gaps do grow
    bad = sizes.withColumn("rate", F.lit(0.5))
    assert renewal.bench_acceptance(bad, 0.05, 100).filter("accepted").count() == 0


def test_ledger_has_groups_and_reasons(spark):
    gaps = make(spark)
    cells = gaps.select(*renewal.CELL).distinct().union(spark.createDataFrame([(99, "r", "s")], "record long, label string, side string"))
    rows = renewal.ledger(cells, renewal.cell_tests(gaps, 60, 4, GROUPS), renewal.tie_statistics(gaps), renewal.TREND + renewal.DEPENDENCE, None, tuple(GROUPS), least=3)
    got = rows.collect()
    assert len(got) == 7 * cells.count() and {r.check for r in got} >= set(GROUPS)
    assert all((r.reason == "") == (r.p is not None) for r in got) and {r.reason for r in got if r.record == 99} == {"no usable segment"}
    assert not any(r.verdict == "pass" for r in got if r.check not in GROUPS)  # without a bench only groups can pass
    standing = {(r.record, r.assumption): r for r in assumptions.standing(rows).collect()}
    for r in standing.values():
        of = [x for x in got if x.record == r.record and x.check in next(a.checks for a in assumptions.REGISTRY if a.name == r.assumption)]
        failed = sum(x.verdict == "fail" for x in of)
        assert (r.n_asked, r.n_failed) == (len(of), failed) and (r.standing == "contradicted") == (failed > 0)
    assert {a for _, a in standing} == {a.name for a in assumptions.REGISTRY if a.checks}
    assert assumptions.registry(rows).count() == len(assumptions.REGISTRY)


def test_assumptions_are_whole():
    for bad in (("", "s", "c", "raises"), ("n", "s", "c", "warns"), ("n", "s", "c", "reports")):
        with pytest.raises(ValueError):
            assumptions.Assumption(*bad)


def test_reasons_of_segments(spark):
    rows = [(1, "r", "s", s, i, x, 9.0) for s, xs in enumerate([[1.0, 2.0], [1.0, 0.0, 2.0], [1.0, 1.0, 1.0], [1.0, 2.0, 3.0]]) for i, x in enumerate(xs)]
    gaps = spark.createDataFrame(rows, "record long, label string, side string, segment long, i long, x double, tau double")
    assert {r.segment: r.reason for r in renewal.unusable(gaps).collect()} == {0: "fewer than 3 gaps", 1: "a gap is not positive", 2: "all gaps are equal"}
    assert {r.segment for r in renewal.usable(gaps).collect()} == {3}


def test_the_ledger_runs_its_battery_once(spark, tmp_path):
    """A verdict and the bench behind it come from one pass over the draws, not from a pass each."""
    from pyspark.sql import functions as F

    from tidespan.operators import deal

    passes = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    rows = deal.once(spark.range(10).repartition(2).mapInArrow(work, "id long"))
    assert rows.join(rows.groupBy((F.col("id") % 2).alias("id")).count(), "id", "left").count() == 10 and passes.value == 10


def test_draws_with_different_events_fall_back_to_terms():
    import numpy as np

    from tidespan.operators import renewal

    x = np.array([[1.0, 2, 4, 3], [4.0, 3, 2, 1], [2.0, 1, 3, 4]])
    for tau in (12.0, 10.0):
        t = np.cumsum(x, axis=1)
        events = np.where(tau <= t[:, -1] * renewal.AT_EVENT, 3, 4)
        assert np.allclose(np.stack(renewal._trend_of(x, tau, 0.7)), np.stack(renewal._trend_with_gaps(t, tau, 0.7, events)), rtol=1e-12, atol=1e-13)
    mixed = np.stack(renewal._trend_of(np.array([[1.0, 2, 4, 3], [1.0, 2, 4, 2]]), 10.0, 0.7))
    assert list(mixed[4]) == [3, 4] and np.isfinite(mixed).all()


def test_a_records_cells_are_shuffled_together(monkeypatch):
    """Cells of one record share a sort and tables of partial sums, and give what each gives alone; only a cell whose draws may read different events goes alone."""
    rng, factors, parts = np.random.default_rng(5), renewal.draw_factors(60, 4), []
    for segments in ((3, 4, 5), (14,), (6,), (3, 12, 2), (30,)):
        for segment, n in enumerate(segments):
            x = np.round(rng.exponential(size=n), 1) + 0.1
            parts.append((np.full(n, segment), x, np.full(n, x.sum() + (segment + len(segments)) % 2), rng.integers(0, renewal.PRIME, n), np.full(n, len(parts))))
    segment, x, tau, h, _ = (np.concatenate(v) for v in zip(*parts))
    starts = np.cumsum([0, 12, 14, 6, 17])
    want = [renewal._cell_arrays(*(v[a:b] for v in (segment, x, tau, h)), factors, 5) for a, b in zip(starts, [*starts[1:], len(x)])]
    plain, alone = renewal._cell_arrays, []
    monkeypatch.setattr(renewal, "_cell_arrays", lambda *a: alone.append(len(a[1])) or plain(*a))
    for cached in (renewal.CACHED, 700):
        monkeypatch.setattr(renewal, "CACHED", cached)
        for (runs, events, of), (runs_, events_, of_) in zip(renewal._several_cells(starts, segment, x, tau, h, factors, 5), want, strict=True):
            assert runs == runs_ and (events == events_).all() and all(np.allclose(of[k], of_[k], rtol=1e-10, atol=1e-11) for k in of_)
    few = renewal._several_cells(np.array([0]), segment[:3], x[:3], tau[:3], h[:3], factors, 5)[0][2]  # fewer gaps than lags
    assert all(np.allclose(few[k], v, equal_nan=True) for k, v in plain(segment[:3], x[:3], tau[:3], h[:3], factors, 5)[2].items())
    assert not alone
    tau = np.where(np.arange(len(x)) < 12, tau, tau * (1 + 1e-12))  # the second and the last cell end within rounding of their last event
    renewal._several_cells(starts, segment, x, np.where(np.arange(len(x)) >= 49, x[49:].sum() * renewal.AT_EVENT, tau), h, factors, 5)
    assert 30 in alone


def test_the_least_p_of_draws_needs_no_ranks():
    rng = np.random.default_rng(3)
    members = [rng.integers(0, 9, 40).astype(float), rng.normal(size=40), np.ones(40)]
    least = np.min([renewal.at_or_above(s) / 40 for s in members], axis=0)
    for b in range(40):
        assert renewal.as_low(members, round(40 * least[b])) == (least <= least[b] + 1e-12).mean()
    assert renewal.as_low(members[2:], 40) == 1.0
