"""Queries return all records and cells of the tables."""

from __future__ import annotations

import os

import pytest

from tidespan import registry
from tidespan.operators import renewal
from tidespan.plans import queries_renewal
from tidespan.plans.context import Context

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_turnbull_has_all_cells(spark):
    got = registry.queries()["turnbull"](spark, DATA).groupBy("record", "label", "side").agg({"mass": "sum"}).collect()
    want = Context(spark, DATA).events.select("record", "label", "side").distinct().collect()
    assert {tuple(r)[:3] for r in got} == {tuple(r) for r in want} and len({r[1:] for r in want}) > 1
    assert all(abs(r[3] - 1) < 1e-4 for r in got)


def test_all_neighbours_are_compared(spark):
    c = Context(spark, DATA)
    cells = {tuple(r) for r in c.wins.select("record", "label", "side").distinct().collect()}
    checks = {(r.record, r.label, r.side): ",".join(r.verdicts) for r in renewal.attachments(queries_renewal.ledger(c)).collect()}
    want = {(label, side, i, i + 1, checks.get((i, label, side)), checks.get((i + 1, label, side))) for i, label, side in cells if (i + 1, label, side) in cells}
    got = [(r.label, r.side, r.first, r.second, r.first_verdicts, r.second_verdicts) for r in registry.queries()["pair_checks"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and any(r[2] % 10 for r in got)
