"""Files with failures beside results, run starts, and provenance counted by the write."""

from __future__ import annotations

import json

import pytest

from tidespan.sources import readers, recorded


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    files = {
        "a.yaml": "- {t: 1, v: 2.5}\n- {t: 2, v: [1, 2]}\n", "b.yml": "t: 3\nv: null\n", "bad.yaml": "a: [1, 2", "empty.yaml": " \n", "none.csv": "", "c.json": '[{"t": 1}, 5]', "bad.json": '{"t": ', "d.csv": "t,v\n1,x\n2,\n",
        "short.csv": "t,v\n1\n", "e.h5": "no hdf5 at all", "f.bin": "?",
    }
    for name, text in files.items():
        (at / name).write_text(text)
    (at / "deep").mkdir()
    (at / "deep" / "g.json").write_text('{"t": 9}')
    return at


def test_failures_stand_beside_results(spark, folder):
    got = recorded.scan(spark, str(folder))
    name = lambda p: p.rpartition("/")[2]
    rows = sorted((name(r.path), r.row, tuple(sorted(r.fields.items()))) for r in recorded.results(got).collect())
    assert rows == [
        ("a.yaml", 0, (("t", "1"), ("v", "2.5"))), ("a.yaml", 1, (("t", "2"), ("v", "[1, 2]"))), ("b.yml", 0, (("t", "3"), ("v", None))), ("c.json", 0, (("t", "1"),)), ("c.json", 1, (("value", "5"),)),
        ("d.csv", 0, (("t", "1"), ("v", "x"))), ("d.csv", 1, (("t", "2"), ("v", ""))), ("g.json", 0, (("t", "9"),)),
    ]
    failed = {name(r.path): (r.stage, r.reason) for r in recorded.failures(got).collect()}
    assert {k: v[0] for k, v in failed.items() if k != "e.h5"} == {"bad.yaml": "parse", "empty.yaml": "parse", "bad.json": "parse", "short.csv": "shape", "f.bin": "open"}
    assert failed["e.h5"][0] in ("open", "parse") and "no reader for .bin" in failed["f.bin"][1] and all(r for _, r in failed.values())


def test_run_start_from_an_attribute(spark):
    rows = [("a", 0, {}, {"measurement_time": "2026-08-13 17:00:15"}), ("a", 1, {}, {"measurement_time": "2026-08-13 17:00:15"}), ("b", 0, {}, {}), ("c", 0, {}, {"measurement_time": "soon"}), ("d", 0, {}, {"measurement_time": "1970-01-02 00:00:00"})]
    df = spark.createDataFrame([(*r, None, None) for r in rows], recorded._SCHEMA)
    got = {r.path: (r.start_us, r.reason) for r in recorded.run_start(df).collect()}
    assert got == {"a": (1_786_640_415_000_000, ""), "b": (None, "no attribute measurement_time"), "c": (None, "no time"), "d": (None, "no plausible time")}


def test_provenance_counts_rows_in_the_write(spark, tmp_path, folder):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "`a.b` long, c string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("save", "")
    path = readers.save_artifact(df, str(tmp_path), "t", {"k": 1}, {"files": f"{folder}/deep"})
    jobs = len(tracker.getJobIdsForGroup("save"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    record = json.loads(spark.read.text(f"{path}/provenance").first()[0])
    assert record["rows"] == 3 and record["nulls"] == {"a.b": 0, "c": 2} and record["environment"]["pyspark"] and record["inputs"]["files"]["fingerprint"][0] == 1
    assert jobs <= 4  # the data, the record, and the listing of one input; no count of the data
    assert readers.load_artifact(spark, str(tmp_path), "t", {"k": 1}).count() == 3
