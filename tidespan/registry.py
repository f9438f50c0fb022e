"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidespan.plans import queries_metrics, queries_panels, queries_renewal, queries_survival, queries_windows
from tidespan.plans.context import Context
from tidespan.plans.define import Query

MODULES = (queries_windows, queries_survival, queries_renewal, queries_metrics, queries_panels)


def _all() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        for q in module.QUERIES.all:
            if q.name in out:
                raise ValueError(f"query {q.name} is defined twice")
            out[q.name] = q
    return out


def _run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.build(Context(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, q) for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in _all().items() if q.oracle}
