"""Carving of a live stream: windows leave as soon as they end.

The gap threshold is a statistic of a whole record, so a stream takes it as a parameter. Reads of a record must come in order of time
within the watermark: those behind it are dropped and counted by Spark, those behind the record's own last read are skipped and counted in
``n_late`` of the next window that leaves. State per record and rung is one open window. Once the watermark is
past the gap after a record's last read, its window ends there, as it would in a batch that had a later read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidespan.operators.carve import IN, OUT, Rung

OUTPUT = "record long, label string, side string, birth_us long, last_us long, death_us long, birth_kind string, death_kind string, n_reads long, min_margin double, n_late long"
STATE = "last_us long, side string, birth_us long, birth_kind string, n long, min_margin double, late long"


def carve_stream(reads: DataFrame, ladder: list[Rung], gap_us: int, delay: str = "1 hour") -> DataFrame:
    """reads: a stream of (record, ts, value) -> ended windows, in append mode."""
    spark = reads.sparkSession
    rungs = spark.createDataFrame([(r.label, float(r.value), r.big_is_good) for r in ladder], "label string, threshold double, big_is_good boolean")
    rows = reads.withWatermark("ts", delay).filter("value is not null and not isnan(value)").crossJoin(F.broadcast(rungs))
    rows = rows.withColumn("t_us", F.unix_micros("ts")).withColumn("margin", F.when(F.col("big_is_good"), F.col("value") - F.col("threshold")).otherwise(F.col("threshold") - F.col("value")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record, label = key
        s = dict(zip(("last", "side", "birth", "kind", "n", "low", "late"), state.get, strict=True)) if state.exists else None
        done = []
        if state.hasTimedOut:
            # n = 0 marks that the window has left; the time of its last read stays, for the kind of the next birth
            done.append((record, label, s["side"], s["birth"], s["last"], s["last"], s["kind"], "gap_start", s["n"], s["low"], s["late"]))
            state.update((s["last"], s["side"], s["birth"], s["kind"], 0, s["low"], 0))
            yield pd.DataFrame(done, columns=[c.split()[0] for c in OUTPUT.split(", ")])
            return
        for pdf in batches:
            for t, m in pdf.sort_values("t_us")[["t_us", "margin"]].itertuples(index=False):
                t, side = int(t), IN if m >= 0 else OUT
                if s is not None and t < s["last"]:
                    s["late"] += 1  # out of order: the record has moved on
                    continue
                gap, late = s is not None and t - s["last"] > gap_us, 0 if s is None else s["late"]
                if s is None or gap or side != s["side"]:
                    if s is not None and s["n"]:
                        done.append((record, label, s["side"], s["birth"], s["last"], s["last"] if gap else t, s["kind"], "gap_start" if gap else "crossing", s["n"], s["low"], late))
                        late = 0
                    s = {"last": t, "side": side, "birth": t, "kind": "scan_start" if s is None else "gap_resume" if gap else "crossing", "n": 0, "low": float("inf"), "late": late}
                s["last"], s["n"], s["low"] = t, s["n"] + 1, min(s["low"], float(m))
        if s is not None:
            state.update((s["last"], s["side"], s["birth"], s["kind"], s["n"], s["low"], s["late"]))
            if s["n"]:
                state.setTimeoutTimestamp(max((s["last"] + gap_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return rows.groupBy("record", "label").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def share_in_spec(reads: DataFrame, threshold: float, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Share of reads in spec per record and tumbling window."""
    rows = reads.withWatermark("ts", delay).groupBy("record", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg((F.col("value") >= threshold).cast("double")).alias("share"))
    return rows.select("record", F.col("w.start").alias("start"), "n", "share")
