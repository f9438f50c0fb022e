"""Exact Jaccard join of documents over word shingles, and its connected components.

Jaccard distance is a metric, and so is the size of the symmetric difference of two sets. Two sets a and b of similarity s or
more differ in at most (1 - s) / (1 + s) * (|a| + |b|) elements. The join narrows in three steps, none of which loses a link.

1. Rings. With the empty set as pivot, the distance of a set is its size. Sizes fall into rings; the triangle inequality bounds
   how far a partner can lie, so a document goes to its own ring and, as a boundary copy, to each ring a larger partner may be in.
2. Cells. Distances between unrelated documents are all 1 or close to it, so document pivots divide nothing at this level (the
   README has figures). The pivots here are parts of the shingle space: a ring with at most t differing elements a pair cuts the
   hash space into k = t + 1 + m cells. A linked pair differs in at most t cells, so it agrees wholly in m + 1 or more. Documents
   whose contents agree in a cell share a region. How many cells must agree follows from the sizes of a pair, and rules most pairs
   out. Pairs that meet in a small region are tested there; a document enters large regions only if it has as many of them as a
   pair needs that meets in no small one.
3. Voronoi regions. Large regions led by the same document form a group. Groups over a bound get documents as pivots; every
   document belongs to its nearest pivot, and enters the region of another as a boundary copy where the triangle inequality lets a
   partner lie there: it is at most twice the link distance farther from that pivot than from its own, and no farther than the
   region's radius and the link distance. Documents linked to one pivot are connected by it and need not meet again, so regions
   without others go. Regions are divided again until they are small enough for one task, which counts overlaps exactly. A
   group in which distances to pivots tell nothing apart (unrelated documents that share a passage) is divided by residuals.

Documents with equal shingle sets are one node, so copies never meet as pairs. Shingles and sets are 64-bit hashes.

Null or empty texts and texts without words have the empty set and link with nothing. Rows with a null doc_id link like others but
never name a component. Repeated rows and repeated ids are kept row by row. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch, slices

#: Groups up to this many documents are finished by pairs, larger ones are divided.
SMALL_GROUP = 24
#: Groups up to this many documents and shingles in all are finished in one task, larger ones are divided.
LEAF_GROUP, LEAF_SHINGLES = 1000, 4_000_000
#: Pivots of a group that is divided.
PIVOTS = 8
#: Columns of signed texts.
SIGNED = "doc_id long, n_shingles long, t long, need long, node long, keys array<long>"
#: Words whose hashes a worker remembers.
WORD_CACHE = 1 << 20
#: Rows up to which a list of ids is broadcast (8 bytes each); a shuffled join serves beyond.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 5
    num: int = 4  # similarity of num / den or more
    den: int = 5
    ring: float = 1.25


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes. bytes.lower() takes A-Z alone, bytes.split() exactly [\\x20\\x09-\\x0D]."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}
        self.weights = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if len(self.seen) > WORD_CACHE:
            self.seen.clear()
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        for x in words:
            if x not in seen:
                seen[x] = digest(x)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
        if n < self.width:  # the whole sequence is the one shingle, told from others by its length
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
        size = n - self.width + 1
        total = np.zeros(size, np.uint64)
        for i in range(self.width):
            total += _mix(h[i : i + size] * self.weights[i] + np.uint64(i))
        return np.unique(_mix(total))


def max_difference(total: int, cfg: JaccardConfig) -> int:
    """The largest symmetric difference of two linked sets whose sizes add up to total."""
    return total * (cfg.den - cfg.num) // (cfg.den + cfg.num)


@lru_cache(maxsize=None)
def _bounds(ring: float) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ring)))
    return np.array(out)


@lru_cache(maxsize=None)
def ring_plan(ring: int, cfg: JaccardConfig) -> tuple[int, int]:
    """(k, m) of a ring: cells, and by how many they exceed the least number that must agree."""
    low, high = int(_bounds(cfg.ring)[ring]), int(_bounds(cfg.ring)[ring + 1]) - 1
    t = max_difference(2 * high, cfg)
    return t + 1 + (m := int(np.ceil(1.5 * (t + 1) * np.exp(-low * cfg.num / cfg.den / (t + 1)))) + 3), m


def ring_difference(n: int, cfg: JaccardConfig) -> int:
    """The largest difference that the ring of a set of n allows for."""
    k, m = ring_plan(int(np.searchsorted(_bounds(cfg.ring), max(n, 1), "right")) - 1, cfg)
    return k - 1 - m


def ring_need(n: int, cfg: JaccardConfig) -> int:
    """The least number of keys that a set of n shares with a linked set. One less covers the rounding of larger partners' rings."""
    high = int(_bounds(cfg.ring)[int(np.searchsorted(_bounds(cfg.ring), max(n, 1), "right"))]) - 1
    return max(2, ring_difference(n, cfg) - max_difference(n + high, cfg) + 1)


def cell_keys(hashes: np.ndarray, cfg: JaccardConfig) -> np.ndarray:
    """A key of 48 bits for each ring and cell of a set. Empty cells have none while so few are empty that linked pairs still share two keys."""
    n, out = len(hashes), []
    first, last = (int(np.searchsorted(_bounds(cfg.ring), x, "right")) - 1 for x in (n, max(n, n * cfg.den // cfg.num)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    for ring in range(first, last + 1):
        k, m = ring_plan(ring, cfg)
        cell = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # grows with the hash, so cells are runs of the sorted set
        ends = np.searchsorted(cell, np.arange(k + 1, dtype=np.uint64))
        keys = _mix((sums[ends[1:]] - sums[ends[:-1]]) ^ _mix(np.arange(k, dtype=np.uint64) + np.uint64(ring << 40 | 1 << 39)))
        full = ends[1:] > ends[:-1]
        out.append(keys[full] if k - int(full.sum()) < m else keys)
    return (np.concatenate(out) >> np.uint64(16)).view(np.int64)


def _node(hashes: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else None


def _signed(cfg: JaccardConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(cfg.words)
        for batch in slices(batches):
            sets = [shingler(x) for x in batch.column("text").to_pylist()]
            keys = [cell_keys(x, cfg) if len(x) else x.view(np.int64) for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([ring_difference(len(x), cfg) for x in sets], pa.int64()), pa.array([ring_need(len(x), cfg) for x in sets], pa.int64()), pa.array([_node(x) for x in sets], pa.int64()), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys]))).cast(pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "t", "need", "node", "keys"],
            )

    return run


def _sets(cfg: JaccardConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(cfg.words)
        for batch in slices(batches):
            sets = [shingler(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def _listed(ids: DataFrame) -> DataFrame:
    """ids: one stored column of long."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class _Join:
    def __init__(self, docs: DataFrame, cfg: JaccardConfig, scratch: Scratch):
        self.cfg, self.scratch, self.spark = cfg, scratch, docs.sparkSession
        self.docs = docs.select("doc_id", "text")
        signed = self.docs.mapInArrow(_signed(cfg), SIGNED).withColumn("row", F.monotonically_increasing_id())
        self.signed = scratch.keep(signed, "signed")
        self.rows = scratch.keep(self.signed.select("doc_id", "n_shingles", "node"), "rows")
        nodes = self.signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("t").alias("t"), F.first("need").alias("need"))
        self.nodes = scratch.keep(nodes, "nodes")
        self.links: DataFrame | None = None

    def regions(self) -> DataFrame:
        """(region, node, size, t, need, n) of the regions of n nodes, two or more. Of copies one row enters. The keys cross the network twice, first as bare counts, then as (region, row) for the regions that are shared."""
        copies = self.scratch.keep(self.signed.select("node", "row").join(self.nodes.filter("n > 1").select("node", F.col("row").alias("first")), "node").filter("row <> first").select("row"), "copies")
        once = self.signed.filter("node is not null").join(_listed(copies), "row", "left_anti")
        keyed = once.select(F.explode("keys").alias("region"), "row")
        shared = self.scratch.keep(keyed.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        self.scratch.drop()
        held = self.scratch.keep(keyed.join(shared.hint("merge"), "region"), "held")  # the same way at every size
        self.scratch.drop(self.signed, copies, shared)  # the keys, the largest table, are not needed again
        regions = self.scratch.keep(held.join(self.nodes.select("row", "node", "size", "t", "need"), "row").drop("row"), "regions")
        self.scratch.drop(held)
        return regions

    def sets(self, some: DataFrame) -> DataFrame:
        """(node, hashes) of some nodes: one more pass over the texts, those of other documents left out at the scan."""
        none = -(1 << 62)
        wanted = self.scratch.keep(some.select("node").distinct().join(self.nodes.select("node", F.coalesce("rep", F.lit(none)).alias("doc_id")), "node"), "wanted")
        ids = self.scratch.keep(wanted.select("doc_id").distinct(), "ids")
        texts = self.docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(none))).join(_listed(ids), "doc_id", "left_semi")
        found = texts.mapInArrow(_sets(self.cfg), "node long, hashes array<long>").filter("node is not null").join(wanted, "node", "left_semi")
        sets = self.scratch.keep(found.groupBy("node").agg(F.first("hashes").alias("hashes")).withColumn("size", F.size("hashes").cast("long")), "sets")
        self.scratch.drop(wanted, ids)
        return sets

    def small_pairs(self, rows: DataFrame, many: DataFrame) -> DataFrame:
        """rows: (region, node, size, t) of small regions; many: (node, large), in how many large regions nodes are -> g (one of the pair's regions), a, b: pairs that may agree in as many cells as a link between sets of their sizes needs.

        A linked pair differs in at most d(|a| + |b|) elements, so of the k = t + 1 + m cells in the ring of the larger set it agrees in
        k - d or more, at most m - 1 of which are empty and have no key: t - d + 2 keys at least. Those that it shares in large regions
        are not counted but bounded.
        """
        num, den = self.cfg.num, self.cfg.den
        rows = rows.join(_listed(many.select("node", "large")), "node", "left").withColumn("large", F.coalesce("large", F.lit(0)))
        one, two = (rows.select("region", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "t", "large"))) for x in "ab")
        met = one.join(two, "region").filter(f"a < b and {den} * least(size_a, size_b) >= {num} * greatest(size_a, size_b)")
        need = F.greatest("t_a", "t_b") - F.expr(f"((size_a + size_b) * {den - num}) div {den + num}") + 2 - F.least("large_a", "large_b")
        return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(need).alias("need"), F.min("region").alias("g")).filter("n >= need").select("g", "a", "b")

    def verify_groups(self, pairs: DataFrame) -> DataFrame:
        """The linked ones among pairs (g, a, b) of small regions g. Each region's sets meet once, in one row of bounded size."""
        ends = pairs.select("g", F.col("a").alias("node")).union(pairs.select("g", "b")).distinct()
        sets = ends.join(self.hashes, "node").groupBy("g").agg(F.collect_list("node").alias("ids"), F.collect_list("hashes").alias("sets"))
        asked = pairs.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
        of = lambda x: f"get(sets, cast(array_position(ids, p.{x}) as int) - 1)"
        tested = sets.join(asked, "g").select(F.expr(f"inline(transform(asked, p -> struct(p.a as a, p.b as b, size({of('a')}) + size({of('b')}) as total, size(array_intersect({of('a')}, {of('b')})) as both)))"))
        return tested.filter(self.cfg.den * F.col("both") >= self.cfg.num * (F.col("total") - F.col("both"))).select("a", "b")

    def solve(self) -> DataFrame:
        """node, label: the least node of the component, for every node with links. ``links`` then holds links that span all components."""
        regions = self.regions()
        own = Window.partitionBy("node")  # no more rows than a document has keys
        large = regions.filter(f"n > {SMALL_GROUP}").select("region", "node", "need", F.count("*").over(own).alias("large"), F.sum("n").over(own).alias("met"))
        many = self.scratch.keep(regions.filter(f"n > {SMALL_GROUP}").groupBy("node").agg(F.count("*").alias("large")), "many")
        pairs = self.scratch.keep(self.small_pairs(regions.filter(f"n <= {SMALL_GROUP}"), many), "pairs")
        # pairs that meet in no small region are left: all the cells in which such a pair agrees are large regions of both
        large = self.scratch.keep(large.filter("large >= need").select("region", "node", "met"), "large")
        # the document that meets most others leads a region, so regions of near copies have few leaders and copies are in few groups
        least = large.groupBy("region").agg(F.max(F.struct("met", "node"))["node"].alias("g"), F.count("*").alias("n")).filter("n > 1").select("region", "g")
        rows = self.scratch.keep(large.join(_listed(least), "region").select("g", "node", F.lit(None).cast("long").alias("known")).distinct(), "groups")
        self.scratch.drop(regions, many, large)
        self.hashes = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(rows.select("node")))
        links = self.scratch.keep(self.verify_groups(pairs), "links")
        self.scratch.drop(pairs)
        while not rows.isEmpty():
            rows, found = self.level(rows)
            links = links.union(found)
        self.links = self.scratch.keep(links.distinct(), "all-links")
        self.scratch.drop(self.hashes)
        return connected(self.links, self.scratch)

    def level(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One level of recursion over groups, a stored table (g, node, known): the groups of the next level, stored, and links found.

        known is the pivot that a document is linked to, if any. Documents with the same one are connected, so groups of such alone go.
        """
        open_ = "n > 1 and (n_known < n or low <> high)"
        groups = rows.join(self.hashes.select("node", "size"), "node").groupBy("g").agg(F.count("*").alias("n"), F.count("known").alias("n_known"), F.min("known").alias("low"), F.max("known").alias("high"), F.sum("size").alias("shingles"))
        groups = self.scratch.keep(groups.filter(open_).select("g", "n", (F.col("n") <= LEAF_GROUP).__and__(F.col("shingles") <= LEAF_SHINGLES).alias("leaf")), "sizes")
        leaves = rows.join(_listed(groups.filter("leaf").select("g")), "g", "left_semi")
        links = self.scratch.keep(leaves.join(self.hashes, "node").select("g", "node", "hashes").groupBy("g").applyInArrow(_leaf(self.cfg), "a long, b long"), "leaf-links")
        big = self.scratch.keep(rows.join(_listed(groups.filter("not leaf").select("g")), "g", "left_semi"), "big")
        self.scratch.drop(rows)
        if big.isEmpty():
            return big, links
        inner, undivided, found = self.voronoi(big)
        links = links.union(found)
        if not undivided.isEmpty():
            deeper, found = self.residual(undivided)
            inner, links = self.scratch.keep(inner.union(deeper), "inner"), links.union(found)
        self.scratch.drop(big, groups)
        return inner, links

    def voronoi(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Groups (g, node, known) -> their Voronoi regions (g, node, known), the groups that pivots do not divide, and links to pivots.

        A linked pair x, y at a distance of at most h, y nearest to q: d(x, q) <= h + d(y, q) <= h + d(y, p) <= 2h + d(x, p) for any pivot p,
        so x is in the region of q if all are let in that lie at most 2h farther from q than from their own pivot. Of the two regions of
        a pair the one with the larger pivot does. And d(x, q) <= h + d(y, q), at most h and the radius of q's region.
        """
        num, den, h = self.cfg.num, self.cfg.den, 1 - self.cfg.num / self.cfg.den + 1e-9
        picks = rows.groupBy("g").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(PIVOTS)))).alias("p"))
        pivots = picks.select("g", F.explode("p").alias("p")).join(self.hashes.select(F.col("node").alias("p"), F.col("hashes").alias("hp")), "p")
        pivots = self.scratch.keep(pivots.groupBy("g").agg(F.collect_list(F.struct("p", "hp")).alias("pivots")), "pivots")
        to = "transform(pivots, q -> struct(q.p as p, size(q.hp) as s, size(array_intersect(hashes, q.hp)) as o))"
        met = rows.join(self.hashes, "node").join(pivots, "g").select("g", "node", "known", "size", F.expr(to).alias("to"))
        met = met.select("g", "node", "known", F.expr(f"transform(to, q -> struct(1 - q.o / (size + q.s - q.o) as d, q.p as p, {den} * q.o >= {num} * (size + q.s - q.o) as linked))").alias("to"))
        met = self.scratch.keep(met.withColumn("own", F.array_min("to")), "distances")
        each = met.select("g", "node", "known", F.col("own.d").alias("own_d"), F.col("own.p").alias("own_p"), F.explode("to").alias("q")).select("g", "node", "known", "own_d", "own_p", "q.*")
        links = self.scratch.keep(each.filter("linked and node <> p").select(F.col("p").alias("a"), F.col("node").alias("b")), "pivot-links")
        radius = met.groupBy("g", F.col("own.p").alias("p")).agg(F.max("own.d").alias("radius"))
        there = each.filter(F.col("d") <= F.col("own_d") + 2 * h).filter("p >= own_p").join(radius, ["g", "p"]).filter((F.col("p") == F.col("own_p")) | (F.col("d") <= F.col("radius") + h))
        there = there.select("g", "p", "node", F.when(F.col("linked"), F.col("p")).otherwise(F.col("known")).alias("known"))
        there = self.scratch.keep(there, "regions")
        n = rows.groupBy("g").agg(F.count("*").alias("n"))
        kept = there.groupBy("g", "p").agg(F.count("*").alias("k"), (F.count("known") < F.count("*")).alias("any"), (F.min("known") < F.max("known")).alias("two")).filter("any or two")
        stuck = self.scratch.keep(kept.groupBy("g").agg(F.max("k").alias("k"), F.sum("k").alias("total")).join(n, "g").filter("4 * k > 3 * n or total > 3 * n").select("g"), "stuck")
        inner = there.join(kept.select("g", "p"), ["g", "p"], "left_semi").join(_listed(stuck), "g", "left_anti")
        inner = self.scratch.keep(inner.select(F.xxhash64("g", "p").alias("g"), "node", "known"), "inner")
        undivided = self.scratch.keep(rows.join(_listed(stuck), "g", "left_semi"), "undivided")
        self.scratch.drop(pivots, met, there)
        return inner, undivided, links

    def residual(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups (g, node, known) that documents as pivots do not divide -> smaller groups of the next level and links found.

        The pivot of a group is its consensus, the shingles that more than half of its sets have. A set is known by its residual, its
        symmetric difference with the pivot: |a ^ b| = |res(a) ^ res(b)|. Where the residuals of a pair together are no larger than a link
        allows, the triangle inequality proves the link; all such pairs are linked to the set that lies nearest by that measure, the
        hub, so the hub's links connect them. Documents linked to the hub need not meet again, only others and these. Any other linked
        pair must share many residual elements, so one of them is among the rarest of both residuals. Documents that share such an
        element form a group of the next level, at most half as large (who has an element outside the consensus, or lacks one inside
        it, is a minority), finished by pairs once small. Only elements of documents not linked to the hub count for this: leaving out
        others moves those that stay to the front.
        """
        num, den = self.cfg.num, self.cfg.den
        sets = rows.join(self.hashes, "node")
        n = rows.groupBy("g").agg(F.count("*").alias("n"))
        often = sets.select("g", F.explode("hashes").alias("e")).groupBy("g", "e").agg(F.count("*").alias("k"))
        pivot = often.join(_listed(n), "g").filter("2 * k > n").groupBy("g").agg(F.collect_list("e").alias("pivot"))  # twice the mean size of a set at most
        pivot = self.scratch.keep(n.join(pivot, "g", "left").select("g", F.coalesce("pivot", F.array().cast("array<bigint>")).alias("pivot")), "pivots")
        res = sets.join(pivot, "g").select("g", "node", "known", "size", F.concat(F.array_except("hashes", "pivot"), F.array_except("pivot", "hashes")).alias("res"))
        res = self.scratch.keep(res.withColumn("r", F.size("res").cast("long")).withColumn("slack", (den + num) * F.col("r") - (den - num) * F.col("size")), "residuals")
        hub = res.groupBy("g").agg(F.min(F.struct("slack", "node", "size", "r", "res")).alias("hub"))
        apart = F.col("r") + F.col("hub.r") - 2 * F.size(F.array_intersect("res", "hub.res"))
        seen = res.join(hub, "g").withColumn("linked", (den + num) * apart <= (den - num) * (F.col("size") + F.col("hub.size")))
        # how many of the rarest elements of a residual a partner with a larger (probe) or smaller (index) one must meet
        most = F.expr(f"((size + size * {den} div {num}) * {den - num}) div {den + num}")
        seen = seen.select("g", "node", "size", "r", "res", most.alias("t"), "linked", F.col("hub.node").alias("hub"), F.when(F.col("linked"), F.col("hub.node")).otherwise(F.col("known")).alias("known"))
        seen = self.scratch.keep(seen, "seen")
        links = seen.filter("linked and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        each = seen.select("g", "node", "known", "linked", "size", "r", "t", F.explode("res").alias("e"))
        counts = each.groupBy("g", "e").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("others"), F.min("node").alias("node"))
        counts = self.scratch.keep(counts.filter("others > 0"), "counts")
        alone = counts.filter("k = 1").groupBy("g", "node").agg(F.count("*").alias("alone"))
        # who has more elements of its own than a partner may lack has no partner
        open_ = seen.join(alone, ["g", "node"], "left").filter("coalesce(alone, 0) <= t").select("g", "node", "known", "linked", "size", "r", "t", "alone", F.explode("res").alias("e"))
        placed = open_.join(counts.filter("k > 1").select("g", "e", "k"), ["g", "e"])
        placed = placed.withColumn("rank", F.coalesce("alone", F.lit(0)) + F.row_number().over(Window.partitionBy("g", "node").orderBy("k", "e")))
        probe = self.scratch.keep(placed.filter("rank <= t + 1").select("g", F.xxhash64("g", "e").alias("h"), "node", "known", "linked", "size", "r", (F.col("rank") <= F.floor(F.col("t") / 2) + 1).alias("index")), "probe")
        sizes = self.scratch.keep(probe.groupBy("h").agg(F.count("*").alias("n"), F.max("index").alias("index"), F.min("linked").alias("linked")).filter("n > 1 and index and not linked").select("h", "n"), "sizes")
        small = probe.join(sizes.filter(f"n <= {SMALL_GROUP}").select("h"), "h")
        one, two = (small.filter(only).select("h", F.col("g").alias(f"g_{x}"), F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("linked", "size", "r"))) for x, only in (("a", "true"), ("b", "index")))
        fit = (F.col("a") != F.col("b")) & ~(F.col("linked_a") & F.col("linked_b")) & (F.struct("r_b", "b") < F.struct("r_a", "a")) & ((den + num) * (F.col("r_a") - F.col("r_b")) <= (den - num) * (F.col("size_a") + F.col("size_b")))
        pairs = one.join(two, "h").filter(fit).select(F.col("g_a").alias("g"), "a", "b").distinct()
        ends = [seen.select("g", F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("res").alias(f"res_{x}")) for x in "ab"]
        apart = F.size("res_a") + F.size("res_b") - 2 * F.size(F.array_intersect("res_a", "res_b"))
        tested = pairs.join(ends[0], ["g", "a"]).join(ends[1], ["g", "b"]).filter((den + num) * apart <= (den - num) * (F.col("size_a") + F.col("size_b"))).select("a", "b")
        found = self.scratch.keep(tested.union(links), "found")
        deeper = self.scratch.keep(probe.join(sizes.filter(f"n > {SMALL_GROUP}").select("h"), "h").select(F.col("h").alias("g"), "node", "known"), "groups")
        self.scratch.drop(pivot, res, seen, counts, probe, sizes)
        return deeper, found


def _spanning(nodes: np.ndarray, adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a boolean adjacency matrix."""
    left, out = np.ones(len(nodes), bool), []
    for start in range(len(nodes)):
        if not left[start]:
            continue
        left[start] = False
        reached = [start]
        for x in reached:
            new = np.flatnonzero(adjacent[x] & left)
            left[new] = False
            reached.extend(new.tolist())
            out += [(int(nodes[x]), int(nodes[y])) for y in new]
    return out


def _leaf(cfg: JaccardConfig):
    """One group of bounded size (node, hashes) -> links a, b that span its components. Overlaps of all its sets are counted through shared elements."""

    def run(group: pa.Table) -> pa.Table:
        nodes, lists = group.column("node").to_numpy(), group.column("hashes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(nodes)), size)
        _, element, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = times[element] > 1
        owner, element = owner[common], element[common]
        order = np.argsort(element, kind="stable")
        having = owner[order]  # the sets that have an element, element by element
        start = np.concatenate([[0], np.cumsum(np.bincount(element, minlength=len(times)))])
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(nodes)))])
        adjacent = np.zeros((len(nodes), len(nodes)), bool)
        for x in range(len(nodes)):
            mine = element[first[x] : first[x + 1]]
            length = start[mine + 1] - start[mine]
            at = np.arange(length.sum()) + np.repeat(start[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(mine) else np.empty(0, np.int64)
            both = np.bincount(having[at], minlength=len(nodes))
            adjacent[x] = (both > 0) & (cfg.den * both >= cfg.num * (size[x] + size - both))
        adjacent[np.arange(len(nodes)), np.arange(len(nodes))] = False
        links = _spanning(nodes, adjacent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of links a, b (long) by alternating large-star and small-star steps: node, label.

    Rows a round are at most twice the links; both steps aggregate before they join. Rounds end when every edge leads to a root.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = scratch.keep(small, "stars")
        roots = edges.select(F.col("v").alias("u")).distinct()
        parents = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if edges.join(roots, "u", "left_semi").union(edges.join(parents, "u", "left_semi")).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _labelled(join: _Join) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every row."""
    labels = join.solve()
    ids = join.nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = ids.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = join.scratch.keep(ids.join(least, "label").select("node", "component_id"), "known")
    return join.rows.join(known, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links (itself included)."""
    return _labelled(_Join(docs, cfg, Scratch(docs.sparkSession, "jaccard"))).drop("node")


def jaccard_links(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """Spanning links between documents with different sets (a, b: the smallest doc_id of each set): enough to connect every component."""
    join = _Join(docs, cfg, Scratch(docs.sparkSession, "jaccard"))
    join.solve()
    links, reps = join.links, join.nodes.select("node", "rep")
    return links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("doc_a")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("doc_b")), "b").select("doc_a", "doc_b")


def jaccard_representatives(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row of each component, one with the smallest doc_id (nulls last), with the columns it came with. Documents without words all stay.

    Where rows repeat the smallest id, one of them stays; where a component has no id at all, one of its rows stays.
    """
    spark, cols = docs.sparkSession, docs.columns
    join = _Join(docs, cfg, Scratch(spark, "jaccard"))
    labels = join.solve()
    scratch = Scratch(spark, "representatives")
    ids = join.nodes.select("node", "rep", "row").join(labels, "node", "left").select("node", "rep", "row", F.coalesce("label", "node").alias("label"))
    least = ids.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "row", "node")).alias("m"))
    chosen = scratch.keep(least.select("m.node", "m.rep"), "chosen")
    many = scratch.keep(join.rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    keep = join.rows.filter("node is null").select("doc_id").union(chosen.select("rep")).filter("doc_id is not null").distinct().join(many, "doc_id", "left_anti")
    stay = docs.join(keep, "doc_id", "left_semi").select(cols)
    odd = docs.filter("doc_id is null")
    if many.isEmpty() and odd.isEmpty():
        return stay
    # ids that are repeated or missing do not name a row: such rows are told apart by the sets of their texts
    odd = odd.select(cols).union(docs.join(many, "doc_id", "left_semi").select(cols))
    odd = odd.select("doc_id", "text", F.xxhash64("text").alias("h"), F.struct(*cols).alias("doc"), F.xxhash64(*cols).alias("order"))
    texts = odd.groupBy("h").agg(F.first("text").alias("text")).select(F.col("h").alias("doc_id"), "text")
    nodes = scratch.keep(texts.mapInArrow(_signed(cfg), SIGNED).select(F.col("doc_id").alias("h"), "node"), "odd")
    odd = odd.join(nodes, "h")
    one = odd.join(chosen, "node").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("node").agg(F.min_by("doc", F.struct("text", "order")).alias("doc"))
    return stay.union(odd.filter("node is null").select("doc.*")).union(one.select("doc.*"))
