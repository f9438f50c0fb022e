"""Sources and sinks: formats by extension, records with declared metadata, failures beside results, artifacts and provenance."""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS: dict[str, Callable[..., DataFrame]] = {}


class DataUnavailable(FileNotFoundError):
    """A table that is not where it was looked for; names the places."""

    def __init__(self, name: str, places: list[str], note: str = ""):
        super().__init__(f"{name} is not at {', '.join(places)}" + (f" ({note})" if note else ""))


@dataclass(frozen=True)
class Source:
    """Where a record is and what is declared of it. ``extra`` goes to the metadata, ``options`` to the reader alone."""

    record: str
    path: str
    schema: T.StructType | None = None
    extra: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)


def reader(*extensions: str):
    """Registers a reader under its extensions; taking one twice is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for e in extensions:
            if e in READERS:
                raise ValueError(f"extension {e} has a reader already")
            READERS[e] = f
        return f

    return add


@reader("csv")
def read_csv(spark: SparkSession, source: Source) -> DataFrame:
    r = spark.read.options(**({"header": "true"} | source.options))
    return (r.schema(source.schema) if source.schema else r).csv(source.path)


@reader("parquet")
def read_parquet(spark: SparkSession, source: Source) -> DataFrame:
    r = spark.read.options(**source.options)
    return (r.schema(source.schema) if source.schema else r).parquet(source.path)


@reader("json", "jsonl")
def read_json(spark: SparkSession, source: Source) -> DataFrame:
    r = spark.read.options(**source.options)
    return (r.schema(source.schema) if source.schema else r).json(source.path)


@reader("yaml", "yml")
def read_yaml(spark: SparkSession, source: Source) -> DataFrame:
    """A list gives a row per item, a mapping one row, anything else a row with ``value``; values are strings (nested ones JSON)."""
    if importlib.util.find_spec("yaml") is None:
        raise DataUnavailable(source.path, ["PyYAML"], "the YAML reader needs PyYAML")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, default=str)
        for batch in batches:
            rows = []
            for doc in batch.column("value").to_pylist():
                loaded = yaml.safe_load(doc)
                for item in loaded if isinstance(loaded, list) else [loaded]:
                    rows.append({str(k): text(v) for k, v in item.items()} if isinstance(item, dict) else {"value": text(item)})
            yield pa.RecordBatch.from_arrays([pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))], names=["fields"])

    rows = spark.read.text(source.path, wholetext=True).mapInArrow(parse, "fields map<string,string>")
    names = [f.name for f in source.schema] if source.schema else None
    if names is None:
        return rows
    return rows.select(*[F.expr(f"try_cast(fields['{f.name}'] as {f.dataType.simpleString()})").alias(f.name) for f in source.schema])


@reader("h5", "hdf5")
def read_hdf5(spark: SparkSession, source: Source) -> DataFrame:
    """One dataset of each file (``options['key']``, or the only one), a row per element or per row of two dimensions. Needs h5py on the executors."""
    if importlib.util.find_spec("h5py") is None:
        raise DataUnavailable(source.path, ["h5py"], "the HDF5 reader needs h5py")
    key = source.options.get("key")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import h5py

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    names = [k for k in f if isinstance(f[k], h5py.Dataset)]
                    name = key or (names[0] if len(names) == 1 else None)
                    if name is None:
                        raise ValueError(f"{path} holds {len(names)} datasets; name one")
                    data = f[name][...]
                    if data.ndim not in (1, 2):
                        raise ValueError(f"{path}:{name} has {data.ndim} dimensions")
                    attrs = {k: str(v) for k, v in f.attrs.items()}
                rows = data.reshape(len(data), -1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array([list(attrs.items())] * len(rows), pa.map_(pa.string(), pa.string()))], names=["path", "row", "values", "attrs"])

    files = spark.read.format("binaryFile").load(source.path).select("path", "content")
    return files.mapInArrow(parse, "path string, row long, values array<double>, attrs map<string,string>")


def load(spark: SparkSession, source: Source) -> DataFrame:
    """The table of a source, by its extension."""
    ext = source.path.rstrip("/").rpartition(".")[2].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}; there are {sorted(READERS)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(source.path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(c in source.path for c in "*?[{") and not fs.exists(path):
        raise DataUnavailable(source.record, [source.path])
    return READERS[ext](spark, source)


def files_of(spark: SparkSession, path: str) -> list:
    """[files, bytes, digest of their names, lengths and times] under a path: equal as long as no file is added, taken away or replaced. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return list(files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))), F.lit(0))).first())


def load_record(spark: SparkSession, source: Source) -> DataFrame:
    """A source with its name and declared metadata on every row."""
    pairs = [F.lit(x) for kv in sorted(source.extra.items()) for x in kv]
    return load(spark, source).withColumn("record", F.lit(source.record)).withColumn("meta", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))


def clean_reads(rows: DataFrame, time: str, value: str, sigma: str | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads, failures) of records with textual or numeric columns: what is no finite number is dropped and counted; a record without any read left is a failure, not an absence.

    Reads of one time stand in the order of the column ``order``, without it in that of a hash of what they say, so file splits do not matter.
    """
    num = lambda c: F.expr(f"try_cast(`{c}` as double)")
    typed = rows.select("record", (num(time) * 1e6).cast("long").alias("t_us") if dict(rows.dtypes)[time] != "timestamp" else F.unix_micros(time).alias("t_us"), num(value).alias("value"), (num(sigma) if sigma else F.lit(None).cast("double")).alias("sigma"), (F.col(order) if order else F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in (time, value, sigma) if c])).alias("seq"))
    ok = F.col("t_us").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    good = F.coalesce(ok, F.lit(False))
    counts = typed.groupBy("record").agg(F.count_if(good).alias("n_kept"), F.count_if(~good).alias("n_dropped"))
    failures = counts.filter("n_kept = 0").select("record", F.lit("clean").alias("stage"), F.concat(F.lit("no valid read among "), F.col("n_dropped").cast("string")).alias("reason"))
    return typed.filter(good), failures


def status_log(rows: DataFrame, codes: dict[str, int], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, violations) of a log with columns time, name, value, status: strict time format, known statuses, codes that match, one device.

    Samples of one time stand in the order of the column ``order``, without it in that of their codes.
    """
    t = F.try_to_timestamp(F.when(F.col("time").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\+00:00$"), F.substring("time", 1, 19)))
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("status")]
    typed = rows.withColumn("t", t).withColumn("code", code)
    reason = F.when(F.col("t").isNull(), "time format").when(F.col("code").isNull(), "unknown status").when(F.col("code") != F.col("value"), "code does not match status")
    bad = typed.select("name", "time", reason.alias("reason")).filter("reason is not null")
    devices = typed.agg(F.count_distinct("name").alias("n")).filter("n > 1").select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("time"), F.lit("several devices").alias("reason"))
    samples = typed.filter(reason.isNull()).select(F.col("name").alias("record"), F.unix_micros("t").alias("t_us"), "status", (F.col(order) if order else F.col("code").cast("long")).alias("seq"))
    return samples, bad.union(devices)


def calibration_log(rows: DataFrame, time: str = "date") -> DataFrame:
    """One event per row; every other column goes to a payload."""
    rest = [c for c in rows.columns if c not in (time, "record", "meta")]
    return rows.select("record", F.unix_micros(F.col(time).cast("timestamp")).alias("t_us"), F.to_json(F.struct(*rest)).alias("payload") if rest else F.lit("{}").alias("payload"))


def schema_stub(df: DataFrame) -> str:
    """A schema in Python, to start a declaration from."""
    lines = ",\n".join(f'    T.StructField("{f.name}", T.{type(f.dataType).__name__}(), {f.nullable})' for f in df.schema.fields)
    return f"T.StructType([\n{lines},\n])"


def identity(spec: dict) -> str:
    """A digest of parameters in canonical JSON: equal content, equal id."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def environment() -> dict[str, str]:
    """What a result was made with."""
    import platform

    import numpy
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pa.__version__, "numpy": numpy.__version__, "platform": platform.platform()}


def save_artifact(df: DataFrame, root: str, name: str, spec: dict, inputs: dict[str, str] | None = None) -> str:
    """Writes a result under its identity with a provenance record beside it; returns the path.

    Rows and the nulls of each column are counted by the write itself. ``inputs``: name -> path of what the result was made from; their fingerprints (see ``files_of``) are recorded.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}-{identity(spec)[:12]}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)])
    counted.write.mode("overwrite").parquet(f"{path}/data")
    counts = seen.get
    record = {
        "name": name, "identity": identity(spec), "spec": spec, "schema": json.loads(df.schema.json()), "plan": df._jdf.queryExecution().optimizedPlan().toString(), "rows": counts["rows"],
        "nulls": {c: counts[f"null_{i}"] for i, c in enumerate(df.columns)}, "environment": environment(), "inputs": {k: {"path": p, "fingerprint": files_of(spark, p)} for k, p in (inputs or {}).items()},
    }
    spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")
    return path


def load_artifact(spark: SparkSession, root: str, name: str, spec: dict, schema: T.StructType | None = None) -> DataFrame | None:
    """The saved result of this identity, or None. A schema that differs from the one expected is refused."""
    path = f"{root.rstrip('/')}/{name}-{identity(spec)[:12]}/data"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    df = spark.read.parquet(path)
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{name} was saved with another schema")
    return df


def write_table(df: DataFrame, path: str) -> None:
    """An unrounded CSV with a header, for tables that are read by people."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
