"""Running totals over groups too large for one task: two passes over pieces of the order.

A window over a whole group puts the group in one task. Here the order column is cut into pieces of equal ratio (4,096 to a doubling), which
needs no sample and comes out alike in every pass. The first pass totals each piece; a window over these totals alone (at most 4,096
a doubling and key, whatever the number of rows) gives what stands before each piece; the second pass runs within the pieces, all in
parallel, and adds it. Both passes read one exchange of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces to a doubling of the order column, and the least value told from 0.
PER_OCTAVE, LEAST = 4096, 1e-6

#: How parts combine: the aggregate, what two parts give, whether a row's own value counts, and the value of nothing.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, True, lambda: F.lit(0)),
    "product": (F.product, lambda a, b: a * b, True, lambda: F.lit(1.0)),
    "nearest": (F.min, lambda a, b: F.coalesce(b, a), False, lambda: F.lit(None)),
}


def piece(order: str) -> Column:
    """The piece of a non-negative number: larger numbers are never in an earlier one."""
    return F.floor(F.log2(F.greatest(F.col(order), F.lit(LEAST))) * PER_OCTAVE)


def running(rows: DataFrame, key: Sequence[str], order: str, adds: Mapping[str, tuple[Column, str]], down: bool = False, pooled: bool = True) -> DataFrame:
    """``rows`` (their ``order`` distinct within a key) with a column for each of ``adds``: name -> (value, kind).

    Kinds: ``sum`` and ``product`` from the start of the key up to this row, or with ``down`` from its end; ``nearest`` (with ``down``): the least value of
    the rows after this one. ``pooled`` False: one window a key, for keys that are many and small.
    """
    by = lambda c: F.col(c).desc() if down else F.col(c).asc()
    ends = lambda own: (Window.unboundedPreceding, 0 if own else -1)
    if not pooled:
        w = Window.partitionBy(*key).orderBy(by(order))
        return rows.withColumns({n: KINDS[k][0](v).over(w.rowsBetween(*ends(KINDS[k][2]))) for n, (v, k) in adds.items()})
    cut = rows.withColumn("_piece", piece(order))
    totals = cut.groupBy(*key, "_piece").agg(*[KINDS[k][0](v).alias(f"_{n}") for n, (v, k) in adds.items()])
    over = Window.partitionBy(*key).orderBy(by("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_piece").alias("_at"), *[(KINDS[k][0](f"_{n}") if k != "nearest" else F.last(f"_{n}", True)).over(over).alias(f"_{n}") for n, (_, k) in adds.items()])
    local = Window.partitionBy(*key, "_piece").orderBy(by(order))
    cut = cut.withColumns({n: KINDS[k][0](v).over(local.rowsBetween(*ends(KINDS[k][2]))) for n, (v, k) in adds.items()})
    met = F.col("_piece") == F.col("_at")
    for i, c in enumerate(key):
        met = met & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.join(before, met)
    whole = {n: KINDS[k][1](F.coalesce(F.col(f"_{n}"), KINDS[k][3]()), F.col(n)) for n, (_, k) in adds.items()}
    return joined.withColumns(whole).select(*rows.columns, *adds)
