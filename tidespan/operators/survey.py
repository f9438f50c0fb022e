"""Surveys: many records at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.functions import special

VERDICTS = ("pass", "fail", "inconclusive", "ties", "not computed")


def verdict_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Counts per verdict, and the share of rejections among the answers."""
    n = {v: F.count_if(F.col("verdict") == v) for v in VERDICTS}
    return rows.groupBy(*key).agg(*[n[v].alias("n_" + v.replace(" ", "_")) for v in VERDICTS], F.try_divide(n["fail"].cast("double"), (n["pass"] + n["fail"]).cast("double")).alias("rejection_share"))


def expand_all(rows: DataFrame, checks: list[str]) -> DataFrame:
    """Rows whose check is ``(all)`` become one row per check."""
    every = F.when(F.col("check") == "(all)", F.array(*[F.lit(c) for c in checks])).otherwise(F.array("check"))
    return rows.withColumn("check", F.explode(every))


def stack_ledgers(ledgers: dict[str, DataFrame], checks: list[str]) -> DataFrame:
    out = None
    for name, rows in ledgers.items():
        part = expand_all(rows.withColumn("dataset", F.lit(name)), checks)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def record_compliance(occupancy: DataFrame, bounds: DataFrame) -> DataFrame:
    """In-spec share and its bounds per record and rung, with a status instead of a number where there is none."""
    rows = occupancy.join(bounds, ["record", "label"], "left")
    return rows.withColumn("share_status", F.when(F.col("occupancy").isNull(), "no observed time").otherwise("ok")).withColumn("bounds_status", F.when(F.col("lower").isNull(), "no known sigma or no observed time").otherwise("ok"))


def compliance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "label").agg(F.count("*").alias("n_records"), F.count("occupancy").alias("n_computed"), F.avg("occupancy").alias("mean_share"), F.min("lower").alias("least_lower"), F.max("upper").alias("largest_upper"))


def unanswered_reasons(rows: DataFrame) -> DataFrame:
    """How often each reason left a cell unanswered, numbers in the reason replaced."""
    return rows.filter("verdict = 'not computed'").groupBy("check", F.regexp_replace("reason", "[0-9]+", "#").alias("reason")).count()


def cross_check(windows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cells of a ledger that its carve does not have: must be empty."""
    return ledger.join(windows.select("record", "label", "side").distinct(), ["record", "label", "side"], "left_anti")


def summary_table(quantiles: DataFrame, key: list[str], probabilities: list[float]) -> DataFrame:
    """One row per cell, quantiles in columns."""
    return quantiles.groupBy(*key).pivot("p", probabilities).agg(F.first("quantile"))


def asymptotic(statistics: DataFrame) -> DataFrame:
    """p-values of C1, C2 and CvM from their limiting laws."""

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out["c1_p"] = [special.normal_two_sided(x) if pd.notna(x) else None for x in pdf["c1"]]
            out["c2_p"] = [1 - special.ad_cdf(x) if pd.notna(x) else None for x in pdf["c2"]]
            out["cvm_p"] = [1 - special.cvm_cdf(x) if pd.notna(x) else None for x in pdf["cvm"]]
            yield out[["record", "label", "side", "c1_p", "c2_p", "cvm_p"]]

    return statistics.select("record", "label", "side", "c1", "c2", "cvm").mapInPandas(run, "record long, label string, side string, c1_p double, c2_p double, cvm_p double")
