"""How queries are defined: a builder over a context, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.plans.context import Context


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Context], DataFrame]
    oracle: str | None


@dataclass
class Queries:
    all: list[Query] = field(default_factory=list)

    def __call__(self, oracle: str | None = None):
        def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
            self.all.append(Query(f.__name__, f, oracle))
            return f

        return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """A double rounded for comparison across engines. Infinite values become null."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(F.when(F.abs(col) != float("inf"), col), digits)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def whole(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or (c if isinstance(c, str) else "value"))
