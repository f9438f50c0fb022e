"""Conversation prefix trie: every distinct beginning of the conversations, with its members and what sharing it saves.

A conversation is an array of turns, a turn a 128-bit digest and a length. Equal conversations are first gathered in blocks of ids,
so that copies by the million become few rows. The rows are sorted by their arrays over all partitions (any order of digests will do:
equal beginnings stand together). A sweep over each sorted partition compares neighbours: their longest common prefix is where the stack of
open nodes is cut, and a node closes when the stack is cut above it. What a partition's first or last row begins with may go on next door,
so those nodes stay open: the partition hands over two rows, the two paths with what was gathered at each depth. The same sweep over
these rows, in the order of the partitions and ``FAN`` partitions at a time, stitches them, level by level, until one run is left and the root
closes. A task holds a stack as deep as the longest conversation and, until their parent closes, the numbers of the nodes below
it; from ``PENDING`` children on they are written at once and get their parent's id by a join.

Turns without a conversation id are left out. Null roles and texts are empty. Turns of one number are ordered by their digests, so the
order of input rows never matters; repeated turns stay. A conversation is held in one row, so it must fit in a task. An empty table has
no nodes, not even a root. Digests are md5 (a false merge among n turns has a chance of n^2 / 2^129).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch, slices

#: Partitions whose open stacks one task stitches.
FAN = 64
#: Children of one node that wait for it in memory.
PENDING = 20_000
#: Numbers in a block of ids of equal conversations.
ID_BLOCK = 4096
#: Nodes that pending children ask for, up to which they are broadcast (some 30 bytes each); a shuffled join serves beyond.
BROADCAST_NODES = 500_000

_LISTS = {"steps": pa.list_(pa.binary()), "sizes": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "least": pa.list_(pa.int64()), "children": pa.list_(pa.int64()), "leaves": pa.list_(pa.int64()), "saved": pa.list_(pa.int64()), "ends": pa.list_(pa.string())}
_NODE = {"id": pa.binary(), "parent_id": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
_SCHEMA = pa.schema([("part", pa.int64()), ("side", pa.int64()), *_LISTS.items(), *_NODE.items()])
_DDL = "part long, side long, steps array<binary>, sizes array<long>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, near: Callable[[str], str] | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text -> conv_id, steps: the ordered turns as (turn, digest, size). ``near`` may name a key (SQL over conv_id) by
    which conversations are dealt to tasks, so that a later window on ``near`` moves nothing."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter("conv_id is not null").select("conv_id", F.expr(near("conv_id") if near else "conv_id").alias("near"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    return rows.repartition("near").groupBy("near", "conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("steps"))


def _by_turn(a: F.Column, b: F.Column) -> F.Column:
    """Null turns first, then by number, then by digest."""
    x, y = F.coalesce(a["turn"], F.lit(-(2**63))), F.coalesce(b["turn"], F.lit(-(2**63)))
    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(nulls, F.when(x < y, -1).when(x > y, 1).when(a["digest"] < b["digest"], -1).when(a["digest"] > b["digest"], 1).otherwise(0))


@dataclass
class _Open:
    """An open node: what is known of it so far. Its open child is not counted in."""

    step: bytes
    size: int
    id: bytes
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    pending: list[tuple] = field(default_factory=list)
    asked: bool = False

    def add(self, n: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least


class Sweep:
    """The stack over sorted paths. ``last``: nothing follows or precedes these paths, so every node closes."""

    def __init__(self, part: int, last: bool, name_all: bool):
        self.part, self.last, self.name_all = part, last, name_all
        self.stack: list[_Open] = []
        self.first: list[_Open] | None = None
        self.out: list[tuple] = []

    def path(self, steps: list[bytes], sizes: list[int]) -> None:
        """Cut the stack at the longest common prefix with the path before and put the rest of this path on it."""
        keep = 1 if self.stack else 0
        while keep < len(self.stack) and keep <= len(steps) and self.stack[keep].step == steps[keep - 1]:
            keep += 1
        begins = self.first is None
        self.cut(keep)
        if not self.stack:
            self.stack.append(_Open(b"", 0, b""))
        for d in range(len(self.stack) - 1, len(steps)):
            self.stack.append(_Open(steps[d], sizes[d], hashlib.md5(self.stack[-1].id + steps[d]).digest()))
        if begins:
            self.first = list(self.stack)

    def cut(self, keep: int) -> None:
        while len(self.stack) > keep:
            node = self.stack.pop()
            if not self.last and len(self.stack) < len(self.first) and self.first[len(self.stack)] is node:
                self.flush(node, None)  # the first path may have begun next door: its nodes stay open
            else:
                self.close(node)

    def close(self, node: _Open) -> None:
        self.flush(node, node.least)
        depth, leaves, saved = len(self.stack), node.leaves if node.children else 1, node.saved + (node.n - 1) * node.size
        name = node.id if self.asks(node) else None
        row = (name, node.least, depth, node.n, node.children, leaves, saved, node.ends or _NONE)
        if not depth:
            self.out.append((None, None, *row))
            return
        above = self.stack[-1]
        above.add(node.n, node.least, 1, leaves, saved)
        above.pending.append(row)
        if len(above.pending) >= PENDING:
            above.asked = True
            self.flush(above, None)

    def asks(self, node: _Open) -> bool:
        return node.asked or self.name_all

    def flush(self, node: _Open, conv: int | None) -> None:
        """Write the closed children of a node: with its smallest member if that is known, else with its id."""
        self.out += [(None if conv is not None else node.id, conv, *row) for row in node.pending]
        node.pending.clear()

    def end(self) -> list[dict]:
        """Close what can be closed; the open paths as rows."""
        if self.first is None:
            return []
        if self.last:
            self.cut(0)
            return []
        stack, shared = list(self.stack), 0
        while shared < min(len(stack), len(self.first)) and stack[shared] is self.first[shared]:
            shared += 1
        for node in stack:
            self.flush(node, None)
        paths = [(1, stack, 0)] if shared == len(self.first) else [(0, self.first, shared), (1, stack, 0)]
        return [self.handed(side, nodes, since) for side, nodes, since in paths]

    def handed(self, side: int, nodes: list[_Open], since: int) -> dict:
        """A path as a row; the nodes above ``since`` are in the other path's row."""
        own = [x if i >= since else _Open(x.step, x.size, x.id) for i, x in enumerate(nodes)]
        return {"part": self.part, "side": side, "steps": [x.step for x in own[1:]], "sizes": [x.size for x in own[1:]], **{k: [getattr(x, k) for x in own] for k in ("n", "least", "children", "leaves", "saved", "ends")}}

    def written(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            cols = dict(zip(("parent_id", "parent_conv_id", "id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), zip(*self.out, strict=True), strict=True))
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(cols["depth"]), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _sweep_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (steps, sizes, n, least, ids) of a partition -> closed nodes, then the open paths."""
    s, before, sha = Sweep(TaskContext.get().partitionId(), False, False), None, None
    for batch in slices(batches, 1024):
        for steps, sizes, n, least, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if steps == before:
                sha.update(b",")
            else:
                if sha:
                    s.stack[-1].ends = sha.hexdigest()
                before, sha = steps, hashlib.sha256()
                s.path(steps, sizes)
            sha.update(ids.encode())
            s.stack[-1].add(n, least)
        yield from s.written()
    if sha:
        s.stack[-1].ends = sha.hexdigest()
    handed = s.end()
    yield from s.written()
    if handed:
        yield pa.RecordBatch.from_pylist(handed, schema=_SCHEMA)


def _stitcher(last: bool) -> Callable[[pa.Table], pa.Table]:
    def stitch(rows: pa.Table) -> pa.Table:
        items = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["side"]))
        s = Sweep(items[0]["part"] // FAN, last, True)
        for r in items:
            s.path(r["steps"], r["sizes"])
            for d, node in enumerate(s.stack):
                node.add(r["n"][d], r["least"][d], r["children"][d], r["leaves"][d], r["saved"][d])
                node.ends = node.ends or r["ends"][d]
        handed = s.end()
        batches = [*s.written(), *([pa.RecordBatch.from_pylist(handed, schema=_SCHEMA)] if handed else [])]
        return pa.Table.from_batches(batches, schema=_SCHEMA)

    return stitch


def prefix_trie(convs: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """convs: conv_id (distinct), steps: array of (digest, size) -> one row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (summed over its subtree: each node's members less one times the size of its last turn), ends_sha256 (of the
    decimal ids, ascending, comma-joined, of the members that end here)."""
    spark, scratch = convs.sparkSession, Scratch(convs.sparkSession, "trie")
    flat = convs.select("conv_id", F.expr("transform(steps, s -> s.digest)").alias("steps"), F.expr("transform(steps, s -> s.size)").alias("sizes"), F.expr(f"floor(conv_id / {ID_BLOCK})").alias("block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    same = scratch.keep(flat.groupBy("steps", "sizes", "block").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids), "same")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), same.count() // rows_per_part + 1)
    ranged = same.repartitionByRange(parts, "steps").sortWithinPartitions("steps", "block").select("steps", "sizes", "n", "least", "ids")
    swept = scratch.keep(ranged.mapInArrow(_sweep_rows, _DDL), "swept")
    done, handed = [swept], swept.filter("part is not null")
    while (top := handed.agg(F.max("part")).first()[0]) is not None:
        stitched = handed.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_stitcher(top < FAN), _DDL)
        done.append(scratch.keep(stitched, "stitched"))
        handed = done[-1].filter("part is not null")
    nodes = done[0].filter("part is null")
    for more in done[1:]:
        nodes = nodes.unionByName(more.filter("part is null"))
    named = scratch.keep(nodes.filter("id is not null").select("id", F.col("conv_id").alias("above")), "named")
    asked = nodes.filter("parent_id is not null").drop("parent_conv_id").join(F.broadcast(named) if named.count() <= BROADCAST_NODES else named, F.col("parent_id") == named["id"]).withColumnRenamed("above", "parent_conv_id")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.filter("parent_id is null").select(*out).unionByName(asked.select(*out))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null at the root), found in their smallest member. ``turns``: of the conversations the trie was made of."""
    placed = turns.filter("conv_id is not null").withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.unhex(F.md5(F.concat(F.length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))))))
    return nodes.join(placed.select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv_id", "depth"], "left")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c of ``turns`` begins as c - c % family does, with its first crc32(c) % (most + 1) turns, and goes on with its own from there."""
    convs = conversations(turns, lambda c: f"{c} - {c} % {family}")
    head = F.max(F.when(F.col("conv_id") == F.col("near"), F.slice("steps", 1, most))).over(Window.partitionBy("near"))
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {most + 1} as int)")
    return convs.withColumn("head", head).withColumn("h", h).select("conv_id", F.expr("concat(coalesce(slice(head, 1, h), array()), slice(steps, h + 1, size(steps)))").alias("steps"))
