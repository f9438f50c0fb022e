"""Declarative jobs: steps over references, sub-jobs, reuse by identity, and a command line.

A step is a function from DataFrames to a DataFrame. Nothing runs until a sink is asked for, so steps no sink needs cost nothing; a
materialised step is written under its identity (the job, the step, its parameters, the code it can reach, those of everything before it
and the files of its sources) and read again instead of being computed twice.
"""

from __future__ import annotations

import argparse
import inspect
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from types import CodeType, ModuleType

from pyspark.sql import DataFrame, SparkSession

from tidespan.sources.readers import Source, files_of, identity, load_artifact, load_record, save_artifact

RESERVED = {"meta", "record"}


def _named(code: CodeType) -> Iterator[str]:
    """Names that a function's code and the functions within it use, modules it imports among them."""
    yield from code.co_names
    for name in code.co_names:
        yield from (f"{name}.{n}" for n in code.co_names)
    for inner in code.co_consts:
        if isinstance(inner, CodeType):
            yield from _named(inner)


def code_identity(f: Callable) -> str:
    """A digest of a function's module, of all modules of this package (and of the function's own) that it reaches, and of the values it is bound to."""
    bound, seen, todo = [], {}, []
    while isinstance(f, partial):
        bound.append([repr(f.args), repr(sorted(f.keywords.items()))])
        f = f.func
    roots = {__name__.partition(".")[0], (getattr(f, "__module__", None) or "").partition(".")[0]}
    own = lambda name: name.partition(".")[0] in roots
    if inspect.isfunction(f):
        bound.append([repr(f.__defaults__), repr(f.__kwdefaults__)])
        for name, cell in zip(f.__code__.co_freevars, f.__closure__ or (), strict=True):
            value = cell.cell_contents
            if isinstance(value, ModuleType) or callable(value):
                todo.append(value)
            else:
                bound.append([name, repr(value)])
    todo.append(f)
    while todo:
        at = todo.pop()
        name = at.__name__ if isinstance(at, ModuleType) else getattr(at, "__module__", None) or ""
        if name in seen or not own(name) or name not in sys.modules:
            continue
        module = sys.modules[name]
        try:
            seen[name] = inspect.getsource(module)
        except (OSError, TypeError):
            seen[name] = inspect.getsource(at) if inspect.isfunction(at) else name
        for value in vars(module).values():
            if isinstance(value, ModuleType) or inspect.isfunction(value) or inspect.isclass(value):
                todo.append(value)
            if inspect.isfunction(value) and value.__module__ == name:
                todo += [sys.modules[n] for n in _named(value.__code__) if own(n) and n in sys.modules]
    return identity({"bound": bound, "modules": seen})


@dataclass(frozen=True)
class Ref:
    """A reference to a step of a job."""

    job: str
    name: str


@dataclass(frozen=True)
class Step:
    build: Callable[..., DataFrame]
    inputs: tuple[Ref, ...]
    params: tuple[tuple[str, object], ...]


@dataclass
class Job:
    name: str
    steps: dict[str, Step] = field(default_factory=dict)
    sources: dict[str, Source] = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)
    included: dict[str, Job] = field(default_factory=dict)

    def _new(self, name: str) -> Ref:
        if name in RESERVED or name in self.steps or name in self.sources:
            raise ValueError(f"{self.name}: the name {name!r} is reserved or taken")
        return Ref(self.name, name)

    def source(self, name: str, source: Source) -> Ref:
        ref = self._new(name)
        self.sources[name] = source
        return ref

    def step(self, name: str, build: Callable[..., DataFrame], *inputs: Ref, **params) -> Ref:
        ref = self._new(name)
        for i in inputs:
            owner = self if i.job == self.name else self.included.get(i.job)
            if owner is None or i.name not in owner.steps | owner.sources:
                raise ValueError(f"{self.name}: {i} is not known here")
        self.steps[name] = Step(build, inputs, tuple(sorted(params.items())))
        return ref

    def include(self, other: Job) -> Job:
        """Makes another job's steps available; a job that includes this one is refused."""
        if other is self or self.name in other._all_included():
            raise ValueError(f"{self.name} and {other.name} include each other")
        self.included[other.name] = other
        return other

    def _all_included(self) -> set[str]:
        return set(self.included) | {n for j in self.included.values() for n in j._all_included()}

    def materialise(self, ref: Ref) -> None:
        if ref.job != self.name:
            raise ValueError("a job materialises its own steps")
        self.kept.append(ref.name)

    def spec(self, name: str, spark: SparkSession | None = None) -> dict:
        """What determines a step's result; with a session, the names, lengths and times of its sources' files too."""
        if name in self.sources:
            s = self.sources[name]
            files = {"files": files_of(spark, s.path)} if spark else {}
            return {"source": s.path, "record": s.record, "schema": s.schema.json() if s.schema else None, "options": s.options, "extra": s.extra} | files
        step = self.steps[name]
        return {"job": self.name, "step": name, "code": code_identity(step.build), "params": dict(step.params), "inputs": [self._owner(i).spec(i.name, spark) for i in step.inputs]}

    def _owner(self, ref: Ref) -> Job:
        return self if ref.job == self.name else self.included[ref.job]

    def resolve(self, spark: SparkSession, ref: Ref, root: str | None = None) -> DataFrame:
        """The DataFrame of a step: a saved result if there is one of its identity, else built from its inputs (and saved if it is to be kept)."""
        owner = self._owner(ref)
        if owner is not self:
            return owner.resolve(spark, ref, root)
        if ref.name in self.sources:
            return load_record(spark, self.sources[ref.name])
        saved = root is not None and ref.name in self.kept
        spec = self.spec(ref.name, spark) if saved else {}
        if saved and (found := load_artifact(spark, root, ref.name, spec)) is not None:
            return found
        step = self.steps[ref.name]
        out = step.build(*[self.resolve(spark, i, root) for i in step.inputs], **dict(step.params))
        if saved:
            save_artifact(out, root, ref.name, spec)
            return load_artifact(spark, root, ref.name, spec)
        return out

    def run(self, spark: SparkSession, root: str) -> dict[str, DataFrame]:
        return {n: self.resolve(spark, Ref(self.name, n), root) for n in self.kept}


def survival_job(name: str, source: Source, ladder, gap_mult: float = 10.0) -> Job:
    """Reads to windows to curves: the chain of the flagship query as a job over any source of reads."""
    from tidespan.operators import carve, survival

    job = Job(name)
    raw = job.source("raw", source)
    obs = job.step("observed", carve.observed_reads, raw, gap_mult=gap_mult)
    rows = job.step("rows", lambda d, rungs: carve.threshold_reads(d, carve.ladder_frame(d.sparkSession, list(rungs))), obs, rungs=tuple(ladder))
    wins = job.step("windows", carve.windows, rows)
    events = job.step("events", survival.event_table, wins)
    curve = job.step("curve", lambda e: survival.loglog_band(survival.product_limit(survival.risk_table(e))), events)
    for ref in (wins, curve):
        job.materialise(ref)
    return job


def main(argv: list[str] | None = None) -> int:
    """``list`` the queries, ``schema`` of a query, or ``run`` some (or all) into a folder; a query that fails does not stop the others."""
    from tidespan import registry

    p = argparse.ArgumentParser(prog="tidespan")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for what in ("schema", "run"):
        q = sub.add_parser(what)
        q.add_argument("tables")
        q.add_argument("names", nargs="*")
        q.add_argument("--out")
    a = p.parse_args(argv)
    queries = registry.queries()
    if a.what == "list":
        print("\n".join(sorted(queries)))
        return 0
    spark = SparkSession.builder.appName("tidespan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    failed = 0
    for name in a.names or sorted(queries):
        try:
            df = queries[name](spark, a.tables)
            if a.what == "schema":
                print(name, df.schema.simpleString())
            elif a.out:
                df.write.mode("overwrite").parquet(f"{a.out}/{name}")
            else:
                df.show()
        except Exception as e:
            failed += 1
            print(f"{name} failed: {str(e).splitlines()[0]}")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
