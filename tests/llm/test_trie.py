"""The prefix trie against brute force: through Spark, and the sweep and its stitching on their own over every way of cutting."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidespan.llm import trie

NONE = hashlib.sha256(b"").hexdigest()


def brute(convs: dict[int, list[tuple]]) -> list[tuple]:
    """convs: id -> turns (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()), key=str)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows: list[tuple]) -> dict[int, list[tuple]]:
    own = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def table_of(rng, n):
    rows = []
    for c in [*range(n), 10**15, -3, -250]:
        if rng.random() < 0.9:
            for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
                rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é😀", "", None, "a"])))
    rows += [(1, None, "user", "first"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "lost"), (7000, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "rows_per_part"), [(450, 2), (450, 1_000_000), (40, 1)])
def test_against_brute_force(spark, n, rows_per_part):
    rows = table_of(random.Random(n), n)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("near", F.lit(1)).withColumn("steps", F.lit(2))
    got = trie.prefix_trie(trie.rebuilt(df), rows_per_part)
    assert got.columns == COLS and sorted(map(tuple, got.collect()), key=str) == brute(rebuild(rows))


def test_empty_hot_and_deep(spark):
    df = spark.createDataFrame([(c, 0, "user", "same") for c in range(9000)] + [(10_000, t, "user", str(t % 3)) for t in range(3000)], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.conversations(df.limit(0))).count() == 0
    nodes = trie.prefix_trie(trie.conversations(df)).orderBy("depth").collect()
    assert len(nodes) == 3002 and nodes[0].n_convs == 9001 and nodes[0].n_leaves == 2 and nodes[-1].depth == 3000
    hot = next(r for r in nodes if r.depth == 1 and r.conv_id == 0)
    assert hot.ends_sha256 == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest() and hot.saved_tokens == 4 * 8999
    turns = trie.with_turns(trie.prefix_trie(trie.conversations(df.limit(9000))), df).orderBy("depth").collect()
    assert [(r.depth, r.role, r.text) for r in turns] == [(0, None, None), (1, "user", "same")]


def run(paths: list[tuple], cuts: list[int], fan: int) -> list[tuple]:
    """The sweep over parts cut at ``cuts``, stitched ``fan`` at a time; parents by id looked up as the join does."""
    trie.FAN, closed, handed = fan, [], []

    def sweep(part, rows):
        s = trie.Sweep(part, False, False)
        for steps, ids in rows:
            s.path(list(steps), [len(x) for x in steps])
            s.stack[-1].add(len(ids), min(ids))
            s.stack[-1].ends = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
        items = s.end()
        closed.extend(r for b in s.written() for r in b.to_pylist())
        return items

    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(paths)], strict=True)):
        handed += sweep(part, paths[a:b])
    while handed:
        last, groups = max(r["part"] for r in handed) < fan, defaultdict(list)
        for r in handed:
            groups[r["part"] // fan].append(r)
        rows = [r for g in groups.values() for r in trie._stitcher(last)(pa.Table.from_pylist(random.sample(g, len(g)), schema=trie._SCHEMA)).to_pylist()]
        closed += [r for r in rows if r["part"] is None]
        handed = [r for r in rows if r["part"] is not None]
    by_id = {r["id"]: r["conv_id"] for r in closed if r["id"] is not None}
    return sorted((tuple(by_id[r["parent_id"]] if c == "parent_conv_id" and r["parent_id"] is not None else r[c] for c in COLS) for r in closed), key=str)


def test_every_way_of_cutting(monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    for seed in range(300):
        rng = random.Random(seed)
        monkeypatch.setattr(trie, "PENDING", rng.choice([1, 2, 3, 1000]))
        convs = {c: [("u", rng.choice("ab") * rng.randint(1, 2)) for _ in range(rng.randint(0, 5))] for c in range(rng.randint(1, 25))}
        groups = defaultdict(list)
        for c, turns in convs.items():
            groups[tuple(x[1].encode() for x in turns)].append(c)
        paths = sorted(groups.items())
        cuts = sorted(rng.randint(0, len(paths)) for _ in range(rng.randint(0, 8)))
        assert run(paths, cuts, rng.choice([2, 3, 64])) == brute(convs), seed
