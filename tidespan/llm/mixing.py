"""Mixing sources to target weights.

Words (tokens) of a source stand in one stream, documents in the order of their ids, and the stream is cut into blocks of fixed
length; only a source's last block may be shorter. Targets follow the weights, none above ``max_epochs`` times its source. The mix
is a sequence of shards of fixed length. How many slots of a shard go to each source is a multinomial draw conditioned on the
totals: the totals are split in halves, again and again, by exact hypergeometric draws of any size, seeded by their place, so every shard finds its own
counts and the rank of its first slot in each source without any other shard. The r-th slot of a source takes block P(r) of its
epoch, P a keyed Feistel permutation of the block numbers; blocks are joined to documents by their number. The last slot of a source
is cut so that the words it gives equal the rounded target. Everything is a function of the seed: reruns agree.

A null source is a source of its own, the last in order. Null or empty texts have size 0 and are never taken. Rows that are alike in
id and text share out what falls to them; they stay separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one bucket of the prefix sum, on average.
BUCKET_ROWS = 2_000
#: Sources up to which their table is broadcast (some 60 bytes a row); a shuffled join serves beyond.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by the order of sources, repeating
    share: float = 1.5
    max_epochs: float = 2.0
    block: int = 64
    shard_slots: int = 4096
    seed: int = 20240229


def targets(sizes: list[int], cfg: MixConfig) -> list[float]:
    """Words each source should give: the shared total by weight, what exceeds a source's limit reshared among the others."""
    weights = [cfg.weights[i % len(cfg.weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), cfg.share * sum(sizes)
    while open_:
        scale = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if scale * weights[i] > cfg.max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = scale * weights[i]
            break
        for i in over:
            out[i] = cfg.max_epochs * sizes[i]
            rest -= out[i]
            open_.remove(i)
        rest = max(rest, 0.0)
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network on the next even number of bits, walked until it lands inside."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        with np.errstate(over="ignore"):
            self.keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))

    def _round(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_mix64(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (_mix64(right ^ key) & self.mask)
        return left << half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._round(np.asarray(x, np.uint64), back)
        while (outside := out >= self.n).any():
            out[outside] = self._round(out[outside], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


@dataclass(frozen=True)
class SourcePlan:
    """What a source gives: ``slots`` slots, the last one ``last`` words."""

    size: int
    blocks: int
    slots: int
    last: int

    def length(self, block: np.ndarray, width: int) -> np.ndarray:
        return np.where(block == self.blocks - 1, self.size - (self.blocks - 1) * width, width)


def _key(cfg: MixConfig, source: int, epoch: int) -> int:
    return cfg.seed * 1_000_003 + source * 65_537 + epoch


def source_plan(source: int, size: int, target: float, cfg: MixConfig) -> SourcePlan:
    words = min(int(target + 0.5), int(cfg.max_epochs * size))
    if size == 0 or words == 0:
        return SourcePlan(size, 0, 0, 0)
    blocks = -(-size // cfg.block)
    short = size - (blocks - 1) * cfg.block
    epoch, rest = divmod(words, size)
    slots = epoch * blocks
    if rest == 0:
        end = int(Permutation(blocks, _key(cfg, source, epoch - 1))(np.array([blocks - 1]))[0])
        return SourcePlan(size, blocks, slots, short if end == blocks - 1 else cfg.block)
    at = int(Permutation(blocks, _key(cfg, source, epoch)).inverse(np.array([blocks - 1]))[0])  # where the short block comes
    if rest <= at * cfg.block:
        more = -(-rest // cfg.block)
        return SourcePlan(size, blocks, slots + more, rest - (more - 1) * cfg.block)
    rest -= at * cfg.block
    if rest <= short:
        return SourcePlan(size, blocks, slots + at + 1, rest)
    rest -= short
    more = -(-rest // cfg.block)
    return SourcePlan(size, blocks, slots + at + 1 + more, rest - (more - 1) * cfg.block)


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of ``draws`` without replacement are good, by inversion of ``u`` from [0, 1).

    Probabilities follow from the mode's by the ratios of neighbours. Values farther off than the reach have less than 2^-60 of the
    mass together, which no double u can hit. The reach is some ten standard deviations: 5 million values at 10^12 slots.
    """
    low, high, total = max(0, draws - bad), min(draws, good), good + bad
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    reach = 60 + int(10 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))))
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    fall = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    below = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return mode - len(down) + int(np.searchsorted(below, u * below[-1], "right").clip(0, len(below) - 1))


def _halve(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Of ``counts`` slots by source, how many of each lie among the first ``left``: source after source, given those before."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts):
        here = int(counts[i])
        out[i] = hypergeometric(here, rest - here, left, rng.random())
        left, rest = left - int(out[i]), rest - here
    return out


def shard_counts(shard: int, slots: np.ndarray, shards: int, cfg: MixConfig, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots by source in this shard, slots by source before it). ``known`` keeps halvings for the neighbouring shards of a task."""
    low, high, counts, before = 0, shards, slots.copy(), np.zeros_like(slots)
    known = {} if known is None else known
    while high - low > 1:
        mid = (low + high) // 2
        if (low, high) not in known:
            if len(known) > 256:  # halvings of earlier neighbours
                known.clear()
            known[low, high] = _halve(counts, min((mid - low) * cfg.shard_slots, int(counts.sum())), np.random.default_rng([cfg.seed, low, high]))
        left = known[low, high]
        if shard < mid:
            high, counts = mid, left
        else:
            low, counts, before = mid, counts - left, before + left
    return counts, before


class Mix:
    """The plan of a mix of ``docs`` and what follows from it."""

    def __init__(self, docs: DataFrame, cfg: MixConfig = MixConfig()):
        self.cfg, self.spark = cfg, docs.sparkSession
        self.scratch = Scratch(self.spark, "mix")
        text = F.coalesce("text", F.lit(""))
        self.docs = docs.select("doc_id", "source", "text")
        sized = self.docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("tie"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
        self.sized = self.scratch.keep(sized, "sized")
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()  # a row a source
        self.names, self.sizes, self.n = [r.source for r in found], [int(r.size) for r in found], sum(r.n for r in found)
        self.targets = targets(self.sizes, cfg)
        self.plans = [source_plan(i, s, t, cfg) for i, (s, t) in enumerate(zip(self.sizes, self.targets, strict=True))]
        rows = [(i, n, s, t) for i, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets, strict=True))]
        self.sources = self.spark.createDataFrame(rows, "source_ix int, source string, source_size long, target double")

    def with_source(self, df: DataFrame) -> DataFrame:
        side = self.sources.withColumnRenamed("source", "_source")
        return df.join(F.broadcast(side) if len(self.names) <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def placed(self) -> DataFrame:
        """doc_id, tie, size, source_ix, source_size, target and off, the document's first word in its source's stream (documents with words)."""
        buckets = max(1, self.n // BUCKET_ROWS)
        rows = self.with_source(self.sized.filter("size > 0")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
        rows = self.scratch.keep(rows, "rows")
        sums = rows.groupBy("source_ix", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = self.scratch.keep(sums.select("source_ix", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")), "starts")
        inside = Window.partitionBy("source_ix", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("off", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_ix", "bucket"]).withColumn("off", F.col("off") + F.col("start")).drop("start", "bucket")

    def pieces(self, placed: DataFrame) -> DataFrame:
        """A row for each block that a document has words in: block, low and high (words of the block), from_word (of the document)."""
        b = self.cfg.block
        rows = placed.withColumn("block", F.explode(F.expr(f"sequence(off div {b}, (off + size - 1) div {b})")))
        low = F.greatest(F.col("off") - F.col("block") * b, F.lit(0))
        return rows.withColumn("low", low).withColumn("high", F.least(F.col("off") + F.col("size") - F.col("block") * b, F.lit(b))).withColumn("from_word", F.greatest(F.col("block") * b - F.col("off"), F.lit(0)))

    def slots(self) -> DataFrame:
        """The mix: shard, slot (its place in the shard), source_ix, block, take (the words taken from the block's start)."""
        cfg, plans = self.cfg, self.plans
        counts = np.array([p.slots for p in plans], np.int64)
        shards = max(1, -(-int(counts.sum()) // cfg.shard_slots))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict = {}
            for shard in (int(x) for pdf in batches for x in pdf["id"]):
                here, before = shard_counts(shard, counts, shards, cfg, known)
                parts = []
                for s in np.flatnonzero(here):
                    plan, rank = plans[s], np.arange(before[s], before[s] + here[s])
                    block = np.empty(len(rank), np.int64)
                    epochs = rank // plan.blocks
                    for e in np.unique(epochs):
                        at = epochs == e
                        block[at] = Permutation(plan.blocks, _key(cfg, int(s), int(e)))(rank[at] % plan.blocks)
                    take = np.where(rank == plan.slots - 1, plan.last, plan.length(block, cfg.block))
                    parts.append(pd.DataFrame({"source_ix": np.full(len(rank), s, np.int32), "block": block, "take": take}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    out = out.iloc[np.random.default_rng([cfg.seed, 1, shard]).permutation(len(out))].reset_index(drop=True)
                    out.insert(0, "slot", np.arange(len(out)))
                    out.insert(0, "shard", shard)
                    yield out

        tasks = min(shards, max(self.spark.sparkContext.defaultParallelism, shards // 64))
        return self.spark.range(0, shards, 1, tasks).mapInPandas(fill, "shard long, slot long, source_ix int, block long, take long")

    def spans(self) -> DataFrame:
        """The mix as spans of documents: shard, slot, source_ix, block, doc_id, tie, off, from_word and words."""
        met = self.pieces(self.placed()).join(self.scratch.keep(self.slots(), "slots"), ["source_ix", "block"])
        return met.withColumn("words", F.least("high", "take") - F.col("low")).filter("words > 0").select("shard", "slot", "source_ix", "block", "doc_id", "tie", "off", "low", "from_word", "words")

    def texts(self) -> DataFrame:
        """The packed blocks themselves: shard, slot, source, text (words joined by a space). Blocks have a fixed length, so no row is large."""
        words = self.docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w")).dropDuplicates(["doc_id", "tie"])
        spans = self.spans().withColumn("key", F.xxhash64("doc_id", "tie"))
        cut = words.withColumn("key", F.xxhash64("doc_id", "tie")).drop("doc_id", "tie").join(spans, "key").select("shard", "slot", "source_ix", "low", F.expr("array_join(slice(w, cast(from_word + 1 as int), cast(words as int)), ' ')").alias("t"))
        blocks = cut.groupBy("shard", "slot", "source_ix").agg(F.array_sort(F.collect_list(F.struct("low", "t"))).alias("p"))
        return blocks.join(self.sources.select("source_ix", "source"), "source_ix").select("shard", "slot", "source", F.array_join("p.t", " ").alias("text"))

    def digest(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
        placed = self.scratch.keep(self.placed(), "placed")
        slots = self.scratch.keep(self.slots(), "slots").groupBy("source_ix", "block").agg(F.collect_list("take").alias("takes"))  # max_epochs + 1 at most
        met = self.pieces(placed).join(slots, ["source_ix", "block"])
        words = F.expr("aggregate(takes, 0L, (a, t) -> a + greatest(0L, least(high, t) - low))")
        taken = met.groupBy("source_ix", "off").agg(F.sum(words).alias("taken"))
        rows = placed.join(taken, ["source_ix", "off"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        none = self.with_source(self.sized.filter("size = 0")).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        return rows.union(none)


def mix_digest(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    return Mix(docs, cfg).digest()
