"""Cycles of a hand record, sources, jobs and streaming."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidespan.operators import cycles
from tidespan.operators.carve import Rung
from tidespan.plans.jobs import Job, code_identity, survival_job
from tidespan.sources import readers
from tidespan.streaming import windows


def spell_rows(spark, rows):
    return spark.createDataFrame([(1, i, s, a * 10**6, b * 10**6, g, None, 0, 0) for i, (s, a, b, g) in enumerate(rows)], "record long, run long, status string, start_us long, end_us long, gap_after boolean, next_us long, n_identical long, n_conflicting long")


HAND = [("calibrating", 0, 50, False), ("measuring", 50, 300, False), ("calibrating", 300, 320, False), ("calibrating", 320, 340, False), ("idle", 340, 500, False), ("offline", 500, 600, False), ("measuring", 600, 700, False), ("calibrating", 700, 720, False), ("idle", 720, 1000, False)]


def test_cycles_of_a_hand_record(spark):
    live = cycles.stretches(spell_rows(spark, HAND))
    got = sorted((r.start_us // 10**6, r.end_us // 10**6, r.event, r.stretch) for r in cycles.cycles(live).collect())
    assert got == [(50, 300, True, 0), (340, 500, False, 0), (720, 1000, False, 1)]
    d = cycles.dropped_births(live).first()
    assert (d.n_stretches, d.n_dropped, d.n_merged) == (2, 1, 1)


def test_shares_add_up(spark):
    s = {r.status: r.share for r in cycles.status_shares(spell_rows(spark, HAND)).collect()}
    assert abs(sum(s.values()) - 1) < 1e-12 and s["not listed"] == 0 and s["offline"] == 0.1


def test_spells_from_samples(spark):
    rows = [(0, 0, "a"), (10, 1, "a"), (10, 2, "b"), (20, 3, "b"), (20, 4, "b"), (100, 5, "b")]
    samples = spark.createDataFrame([(1, t * 10**6, i, s) for t, i, s in rows], "record long, t_us long, seq long, status string")
    got = [(r.status, r.start_us // 10**6, r.end_us // 10**6, r.gap_after, r.n_identical, r.n_conflicting) for r in cycles.spells(samples, 10.0).orderBy("run").collect()]
    assert got == [("a", 0, 10, False, 0, 0), ("b", 10, 20, True, 1, 1), ("b", 100, 100, False, 0, 0)]
    assert cycles.spell_errors(cycles.spells(samples, 10.0)).isEmpty()


def test_periods_cover_the_exposure(spark):
    live = cycles.stretches(spell_rows(spark, HAND))
    rows = cycles.cycle_periods(live, 3).collect()
    assert abs(sum(r.exposure_h for r in rows) - 900 / 3600) < 1e-12 and sum(r.n_calibrations for r in rows) == 3


def test_periods_read_their_spells_once(spark):
    """One pass over spells that stand computed: no join, and neither spells nor calibrations are worked out anew."""
    live = cycles.stretches(spell_rows(spark, HAND))
    plan = cycles.cycle_periods(live, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 2 and plan.count("Window [") <= 6, plan


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_periods_against_a_loop(spark, n):
    live = cycles.stretches(spell_rows(spark, HAND))
    # observed: 0 to 500, then 600 to 1000 laid after it; calibrations start at 0, 300 and 600, cycles at 50 (complete), 340 and 620 (censored)
    total, starts, began = 900, [0, 300, 600], [(50, "n_complete"), (340, "n_censored"), (620, "n_censored")]
    cuts = [min({0, 300, 600, 500, 900}, key=lambda x: (abs(x * n - total * k), x)) for k in range(1, n)]
    want = {k: {"hours": b - a, "n_calibrations": 0, "n_complete": 0, "n_censored": 0} for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, total], strict=True))}
    for x, name in [*((x, "n_calibrations") for x in starts), *began]:
        want[sum(c <= x for c in cuts)][name] += 1
    rows = cycles.cycle_periods(live, n).collect()
    assert {r.period: {"hours": round(r.exposure_h * 3600), "n_calibrations": r.n_calibrations, "n_complete": r.n_complete, "n_censored": r.n_censored} for r in rows} == want
    assert len(rows) == n


def test_reads_of_no_record_are_one_period(spark):
    live = cycles.stretches(spell_rows(spark, HAND).withColumn("record", F.lit(None).cast("long")))
    assert [(r.period, round(r.exposure_h * 3600), r.n_calibrations, r.n_censored) for r in cycles.cycle_periods(live, 3).collect()] == [(0, 900, 0, 0)]

def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,value\n1,2.5\n2,x\n3,nan\n")
    rows = readers.load_record(spark, readers.Source("r1", str(tmp_path / "a.csv"), extra={"device": "d"}))
    good, failed = readers.clean_reads(rows, "time", "value")
    assert good.count() == 1 and failed.isEmpty() and rows.first().meta == {"device": "d"}
    (tmp_path / "b.csv").write_text("time,value\n1,x\n")
    good, failed = readers.clean_reads(readers.load_record(spark, readers.Source("r2", str(tmp_path / "b.csv"))), "time", "value")
    assert good.isEmpty() and failed.first().record == "r2"
    with pytest.raises(readers.DataUnavailable):
        readers.load(spark, readers.Source("r", str(tmp_path / "none.csv")))
    with pytest.raises(ValueError):
        readers.load(spark, readers.Source("r", str(tmp_path / "a.xyz")))
    with pytest.raises(ValueError):
        readers.reader("csv")(lambda: None)


def test_yaml_rows(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- {a: 1, b: x}\n- {a: 2}\n")
    assert [r.fields for r in readers.load(spark, readers.Source("r", str(tmp_path / "a.yaml"))).collect()] == [{"a": "1", "b": "x"}, {"a": "2"}]


def test_status_log(spark):
    rows = [("2024-01-01 00:00:00+00:00", "q", 1, "idle"), ("2024-01-01 00:01:00", "q", 1, "idle"), ("2024-01-01 00:02:00+00:00", "q", 2, "idle")]
    df = spark.createDataFrame(rows, "time string, name string, value int, status string")
    samples, bad = readers.status_log(df, {"idle": 1})
    assert samples.count() == 1 and sorted(r.reason for r in bad.collect()) == ["code does not match status", "time format"]


def test_job_reuses_by_identity(spark, tmp_path):
    src = str(tmp_path / "reads.parquet")
    spark.range(30).select(F.lit(1).alias("dummy"), (F.col("id") * 1_000_000).alias("t_us"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("value"), F.lit(None).cast("double").alias("sigma")).write.parquet(src)
    job = survival_job("surv", readers.Source("r1", src), [Rung("r3", 3.0)])
    first = job.run(spark, str(tmp_path / "out"))
    again = job.run(spark, str(tmp_path / "out"))
    assert first["curve"].count() == again["curve"].count() > 0
    other = survival_job("surv", readers.Source("r1", src), [Rung("r3", 4.0)])
    assert other.spec("curve") != job.spec("curve")


CALLS = []


def test_job_computes_anew_when_files_or_code_change(spark, tmp_path):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out")

    def build(d):
        CALLS.append(1)
        return d.select("id")

    def job(f):
        j = Job("j")
        j.materialise(j.step("kept", f, j.source("raw", readers.Source("r", src))))
        return j

    spark.range(3).write.parquet(src)
    assert [job(build).run(spark, out)["kept"].count() for _ in range(2)] == [3, 3] and len(CALLS) == 1
    spark.range(5).write.mode("append").parquet(src)
    assert job(build).run(spark, out)["kept"].count() == 8 and len(CALLS) == 2
    ids = {code_identity(f) for f in ((lambda n: lambda d: d.limit(n))(n) for n in (1, 2))}
    assert len(ids) == 2 and code_identity(build) == code_identity(build)


def test_code_identity_follows_called_modules(monkeypatch):
    import inspect

    from tidespan.operators import carve, survival

    def calls(d):
        return survival.event_table(d)

    step, source = (lambda s: lambda d: s.event_table(d))(survival), inspect.getsource
    before = code_identity(step), code_identity(calls)
    monkeypatch.setattr(inspect, "getsource", lambda x: source(x) + ("# changed" if x is carve or x is survival else ""))
    assert code_identity(step) != before[0] and code_identity(calls) != before[1]


def test_ties_do_not_depend_on_row_order(spark):
    codes = {"idle": 1, "busy": 2}
    rows = [("2024-01-01 00:00:00+00:00", "q", 1, "idle"), ("2024-01-01 00:00:00+00:00", "q", 2, "busy")]
    both = [spark.createDataFrame(r, "time string, name string, value int, status string") for r in (rows, rows[::-1])]
    assert len({tuple(sorted(readers.status_log(d, codes)[0].collect())) for d in both}) == 1
    reads = [d.select(F.lit(1).alias("record"), F.lit("5").alias("t"), F.col("value").cast("string").alias("v")) for d in both]
    assert len({tuple(sorted((r.seq, r.value) for r in readers.clean_reads(d, "t", "v")[0].collect())) for d in reads}) == 1


def test_jobs_refuse_cycles_and_unknown_references():
    a, b = Job("a"), Job("b")
    a.include(b)
    with pytest.raises(ValueError):
        b.include(a)
    with pytest.raises(ValueError):
        a.step("meta", lambda: None)
    from tidespan.plans.jobs import Ref

    with pytest.raises(ValueError):
        a.step("x", lambda d: d, Ref("a", "missing"))


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    from tidespan.operators import carve

    vals = [6, 7, 2, 3, 8, 1, 1, 9]
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i + (500 if i > 4 else 0)) for i in range(len(vals))]
    spark.createDataFrame([(1, t, float(v)) for t, v in zip(ts, vals)], "record long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = windows.carve_stream(stream, [Rung("r", 5.0)], gap_us=10 * 60 * 10**6).writeStream.format("memory").queryName("ended").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.side, r.birth_us, r.death_us, r.birth_kind, r.death_kind, r.n_reads) for r in spark.sql("select * from ended").collect()}
    reads = spark.read.parquet(str(tmp_path / "in")).select("record", F.unix_micros("ts").alias("t_us"), F.unix_micros("ts").alias("seq"), "value", F.lit(None).cast("double").alias("sigma"))
    wins = carve.windows(carve.threshold_reads(carve.observed_reads(reads), carve.ladder_frame(spark, [Rung("r", 5.0)])))
    want = {(r.side, r.birth_us, r.death_us, r.birth_kind, r.death_kind, r.n_reads) for r in wins.filter("death_kind <> 'scan_end'").collect()}
    assert got == want


def test_a_silent_record_ends_with_the_watermark(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "record long, ts timestamp, value double"
    spark.createDataFrame([(2, at(0), 6.0), (2, at(1), 7.0), (1, at(0), 1.0), (1, at(500), 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windows.carve_stream(stream, [Rung("r", 5.0)], gap_us=10 * 60 * 10**6).writeStream.format("memory").queryName("silent").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([(2, at(600), 8.0), (2, at(601), 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = [(r.birth_kind, r.death_kind, r.n_reads) for r in spark.sql("select * from silent where record = 2 order by birth_us").collect()]
    assert got == [("scan_start", "gap_start", 2), ("gap_resume", "crossing", 1)]


def test_reads_out_of_order_are_counted(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema, into = "record long, ts timestamp, value double", str(tmp_path / "in")
    put = lambda rows, mode: spark.createDataFrame([(1, at(m), v) for m, v in rows], schema).coalesce(1).write.mode(mode).parquet(into)
    put([(0, 6.0), (5, 7.0)], "error")
    stream = spark.readStream.schema(schema).parquet(into)
    q = windows.carve_stream(stream, [Rung("r", 5.0)], gap_us=10 * 60 * 10**6).writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable()
    for rows in ([(2, 1.0), (3, 1.0), (6, 8.0)], [(7, 1.0)], [(8, 9.0)]):
        put(rows, "append")
        q.processAllAvailable()
    q.stop()
    got = [(r.side, r.n_reads, r.n_late) for r in spark.sql("select * from late order by birth_us").collect()]
    assert got == [("in_spec", 3, 2), ("out_of_spec", 1, 0)]


def test_infidelity_is_refused_right_past_the_first_peak(spark):
    """The cut is the peak, 2.27688, which the SQL names: reads a step of a search grid beyond it have no bounds."""
    from tidespan.operators import metrics

    grid = [2.2765 + 1e-6 * k for k in range(800)]
    assert abs(max(grid, key=lambda x: 1 - metrics.fidelity_value(x)) - metrics.first_peak()) < 6e-6 and metrics.first_peak() == 2.27688
    df = spark.createDataFrame([(2.17, 0.1), (2.2768, 0.00007), (2.2768, 0.0001), (2.27695, 0.0), (-2.2769, 0.0)], "x double, s double")
    got = df.select(*metrics.infidelity_bounds(df.x, df.s)).collect()
    assert [r[0] is None for r in got] == [False, False, True, True, True]
