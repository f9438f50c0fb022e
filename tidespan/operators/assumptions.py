"""What the reliability arithmetic takes for granted, as data: which checks speak to it, and what happens where it fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators.renewal import CELL

#: What the library does where an assumption fails: an error, a verdict beside the number, or nothing it could see.
DISPOSITIONS = ("raises", "reports", "undetected")


@dataclass(frozen=True)
class Assumption:
    name: str
    statement: str
    consequence: str
    disposition: str
    checks: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not (self.name and self.statement and self.consequence):
            raise ValueError(f"assumption {self.name!r} has an empty field")
        if self.disposition not in DISPOSITIONS:
            raise ValueError(f"assumption {self.name!r}: {self.disposition!r} is none of {DISPOSITIONS}")
        if not self.checks and self.disposition == "reports":
            raise ValueError(f"assumption {self.name!r} reports, but no check speaks to it")


REGISTRY = (
    Assumption("no_trend", "Window lengths on a side do not drift over the record.", "A curve averages a changing law and fits no part of the record.", "reports", ("c1", "c2", "cvm", "trend")),
    Assumption("no_serial_dependence", "A window's length says nothing of the next ones.", "Intervals are too narrow: fewer lengths count than were read.", "reports", ("c5", "c6", "dependence")),
    Assumption("renewal", "Window lengths are independent draws of one law.", "Occupancy and mean time between failures do not carry beyond the record.", "reports", ("c1", "c2", "cvm", "c5", "c6")),
    Assumption("censoring_is_uninformative", "A window cut off by a gap or the end would have gone on like others of its age.", "Curves are biased, in a direction that nothing in the record shows.", "undetected"),
    Assumption("gaps_are_resolved", "No window begins and ends between two neighbouring reads.", "Short windows are missing or merged.", "undetected"),
    Assumption("one_carve", "Windows and reads of a comparison come from one carve.", "Counts and times do not belong together.", "raises"),
)


def registry(rows: DataFrame) -> DataFrame:
    """assumption, statement, consequence, disposition, checks: a row an assumption. ``rows``: any DataFrame of the session."""
    return rows.sparkSession.createDataFrame([(a.name, a.statement, a.consequence, a.disposition, list(a.checks)) for a in REGISTRY], "assumption string, statement string, consequence string, disposition string, checks array<string>")


def standing(ledger: DataFrame) -> DataFrame:
    """cell, assumption, n_asked, n_failed, n_unanswered, standing: contradicted if a check that speaks to it fails, open if one does not pass, else not contradicted. An assumption
    that no check speaks to has no row: nothing was asked."""
    known = registry(ledger).select("assumption", F.explode("checks").alias("check"))
    met = ledger.join(F.broadcast(known), "check")
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = met.groupBy(*CELL, "assumption").agg(F.count("*").alias("n_asked"), n("fail").alias("n_failed"), n("not computed").alias("n_unanswered"), n("pass").alias("_passed"))
    return out.withColumn("standing", F.when(F.col("n_failed") > 0, "contradicted").when(F.col("_passed") < F.col("n_asked"), "open").otherwise("not contradicted")).drop("_passed")
