"""Files read one by one, what fails beside what is read: a broken file among good ones costs itself alone.

Files come through Spark's binary reader, so any store that Spark reads will do, and a file is the work of one task. Every file gives its rows, or one row with the
``stage`` that failed (``open``, ``parse``, ``shape``) and the reason; none is skipped but files of no bytes, which Spark's readers do not list. Rows carry their values as a map of strings (nested values as JSON), the file's
attributes likewise, so one scan holds files of any kind and layout. A file must fit in a task; one with nothing in it but white space fails at ``parse``.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, row long, fields map<string,string>, attrs map<string,string>, stage string, reason string"
#: Rows handed on at once.
ROWS = 10_000


class Failed(Exception):
    """A stage that gave up, and why."""

    def __init__(self, stage: str, reason: object):
        super().__init__(f"{stage}: {reason}")
        self.stage, self.reason = stage, str(reason)


def _items(loaded: object) -> list[dict]:
    if loaded is None:
        raise Failed("parse", "nothing in the file")
    return [x if isinstance(x, dict) else {"value": x} for x in (loaded if isinstance(loaded, list) else [loaded])]


def _yaml(content: bytes) -> tuple[list[dict], dict]:
    import yaml

    return _items(yaml.safe_load(content.decode())), {}


def _json(content: bytes) -> tuple[list[dict], dict]:
    return _items(json.loads(content)), {}


def _csv(content: bytes) -> tuple[list[dict], dict]:
    rows = list(csv.reader(io.StringIO(content.decode())))
    if not rows:
        raise Failed("parse", "nothing in the file")
    if bad := next((i for i, r in enumerate(rows[1:], 1) if len(r) != len(rows[0])), None):
        raise Failed("shape", f"row {bad} has {len(rows[bad])} fields of {len(rows[0])}")
    return [dict(zip(rows[0], r, strict=True)) for r in rows[1:]], {}


def _hdf5(content: bytes) -> tuple[list[dict], dict]:
    import h5py

    with h5py.File(io.BytesIO(content), "r") as f:
        sets = {k: f[k][...] for k in f if isinstance(f[k], h5py.Dataset)}
        attrs = dict(f.attrs)
    sizes = {len(v) for v in sets.values() if v.ndim}
    if len(sizes) != 1 or any(v.ndim != 1 for v in sets.values()):
        raise Failed("shape", f"datasets of {sorted(sizes)} rows, {sorted({v.ndim for v in sets.values()})} dimensions")
    return [{k: v[i].item() for k, v in sets.items()} for i in range(sizes.pop())], attrs


KINDS: dict[str, Callable[[bytes], tuple[list[dict], dict]]] = {"yaml": _yaml, "yml": _yaml, "json": _json, "csv": _csv, "h5": _hdf5, "hdf5": _hdf5}


def _text(v: object) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, default=str)


def _read(path: str, content: bytes | None) -> tuple[list[dict], dict]:
    kind = path.rpartition(".")[2].lower()
    if kind not in KINDS:
        raise Failed("open", f"no reader for .{kind}; there are {sorted(KINDS)}")
    try:
        return KINDS[kind](content or b"")
    except Failed:
        raise
    except ImportError as e:
        raise Failed("open", f"the reader needs {e.name}") from e
    except Exception as e:
        raise Failed("parse", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else 'no message'}") from e


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path or pattern: path, row, fields, attrs, and stage and reason where a file failed."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        pairs = pa.map_(pa.string(), pa.string())
        kinds = (pa.string(), pa.int64(), pairs, pairs, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "row", "fields", "attrs", "stage", "reason"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for at, content in zip(files.column("path").to_pylist(), files.column("content").to_pylist(), strict=True):
                try:
                    items, attrs = _read(at, content)
                except Failed as e:
                    yield batch([(at, None, None, None, e.stage, e.reason)])
                    continue
                own = [(k, _text(v)) for k, v in attrs.items()]
                for low in range(0, len(items), ROWS):
                    yield batch([(at, low + i, [(str(k), _text(v)) for k, v in x.items()], own, None, None) for i, x in enumerate(items[low : low + ROWS])])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


def results(scanned: DataFrame) -> DataFrame:
    return scanned.filter("stage is null").drop("stage", "reason")


def failures(scanned: DataFrame) -> DataFrame:
    """path, stage, reason: a row a file that could not be read."""
    return scanned.filter("stage is not null").select("path", "stage", "reason")


def run_start(scanned: DataFrame, attribute: str = "measurement_time") -> DataFrame:
    """path, start_us, reason: when each file's run began, from an attribute that holds a local time, read as UTC; a file without it, or with a time before 2000 or after 2100, has a reason."""
    one = results(scanned).groupBy("path").agg(F.first("attrs").alias("attrs"))
    t = F.unix_micros(F.try_to_timestamp(F.col("attrs")[attribute]))
    fine = (t >= 946_684_800_000_000) & (t < 4_102_444_800_000_000)
    reason = F.when(F.col("attrs")[attribute].isNull(), f"no attribute {attribute}").when(t.isNull(), "no time").when(~fine, "no plausible time").otherwise("")
    return one.select("path", F.when(fine, t).alias("start_us"), reason.alias("reason"))
