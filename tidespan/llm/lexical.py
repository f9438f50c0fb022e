"""Ranked lexical search: an index of compressed posting blocks, searched by block-max WAND.

``build_index`` deals documents to shards (a task's documents, cut at ``IndexConfig.postings``) and writes one row per posting block: a term's
next 128 documents of the shard as gaps and counts of one, two or four bytes each, with the first and last document and the block's impact
frontier, the pairs of (occurrences, document length) that no other pair of the block beats in both. A score rises with occurrences
and falls with length, so the frontier holds the block's maximum impact whatever the corpus statistics turn out to be, and one
pass over the texts is enough. A further row per shard holds its documents' ids and lengths.

``search`` takes the statistics of the whole corpus from the index, keeps the blocks of the terms asked for, brings those of a shard together and
ranks each query there. Pointers move over block boundaries only (shallow moves): the sum of the maximum impacts of the blocks that
cover a range of documents bounds every score in it, and ranges below the threshold, the k-th best score so far, are skipped before any of
their blocks is unpacked. The range with the highest bound is scored first, which sets the threshold early. The best k of each shard
meet in one window. Results are exact: no posting, document or query is left out.

A document's terms are the maximal runs of code points other than ASCII separators, A-Z lower-cased. Null texts have none and count nowhere.
Scores are 64-bit integers; equal scores are ordered by id, null ids first. Rows are documents: repeated ids are ranked each
for itself. Rows of queries are queries, so a repeated id brings a ranking each. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidespan.llm.scratch import Scratch, slices

#: Postings in a block.
BLOCK = 128
_SEPARATOR = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes(32 if c in _SEPARATOR else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHARD_ROW = "shard long, term string, n int, first int, last int, freqs array<int>, norms array<int>, data binary, ids array<long>, sizes array<int>"
_TYPES = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("freqs", pa.list_(pa.int32())), ("norms", pa.list_(pa.int32())), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class IndexConfig:
    postings: int = 4_000_000  # of a shard: some 200 MB while it is sorted


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    query_terms: int = 200_000  # of the queries that are ranked in one pass over the index; more are taken in several


def terms_of(text: str) -> list[bytes]:
    """The terms of a text. All bytes of code points beyond ASCII belong to terms, so the work is done on UTF-8."""
    return text.encode().translate(_FOLD).split()


def _widths(top: np.ndarray) -> np.ndarray:
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def _pack(values: np.ndarray, block: np.ndarray, place: np.ndarray, width: np.ndarray, start: np.ndarray, out: np.ndarray) -> None:
    """Write each value little-endian at its place in its block, in the bytes that its block uses for a value."""
    w = width[block]
    at = start[block] + place * w
    for i in range(4):
        some = w > i
        out[at[some] + i] = (values[some] >> (8 * i)) & 255


def unpack(data: bytes, n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of a block."""
    wide = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}
    gap, count = data[0], data[1]
    docs = np.cumsum(np.frombuffer(data, wide[gap], n, 2).astype(np.int64)) + first
    return docs, np.frombuffer(data, wide[count], n, 2 + n * gap).astype(np.int64)


def _blocks(shard: int, terms: list[str], term: np.ndarray, doc: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of posting blocks. Postings arrive in any order."""
    order = np.lexsort((doc, term))
    term, doc, count = term[order], doc[order].astype(np.int64), count[order].astype(np.int64)
    begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ordinal = np.arange(len(term)) - np.repeat(begins, np.diff(np.r_[begins, len(term)]))
    heads = np.flatnonzero(ordinal % BLOCK == 0)
    n = np.diff(np.r_[heads, len(term)])
    block = np.repeat(np.arange(len(heads)), n)
    place = np.arange(len(term)) - heads[block]
    gap = np.where(place == 0, 0, np.diff(doc, prepend=0))
    wide_gap, wide_count = _widths(np.maximum.reduceat(gap, heads)), _widths(np.maximum.reduceat(count, heads))
    ends = np.cumsum(2 + n * (wide_gap + wide_count))
    starts = np.r_[0, ends[:-1]]
    out = np.zeros(ends[-1], np.uint8)
    out[starts], out[starts + 1] = wide_gap, wide_count
    _pack(gap, block, place, wide_gap, starts + 2, out)
    _pack(count, block, place, wide_count, starts + 2 + n * wide_gap, out)
    norm = sizes[doc]
    by = np.lexsort((norm, -count, block))  # in a block: most occurrences first, then the shortest
    least = norm[by] - (block[by] << 32)
    best = np.flatnonzero(np.r_[True, least[1:] < np.minimum.accumulate(least)[:-1]])  # a block's values are below those of blocks before
    size = np.bincount(block[by][best], minlength=len(heads))
    cut = np.r_[0, np.cumsum(size)].astype(np.int32)
    freqs, norms = count[by][best].astype(np.int32), norm[by][best].astype(np.int32)
    names, last = pa.array(terms), heads + n - 1
    for at in range(0, len(heads), 20_000):
        to = min(at + 20_000, len(heads))
        row = slice(at, to)
        data = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(np.r_[starts[row], ends[to - 1]].astype(np.int32) - np.int32(starts[at])), pa.py_buffer(out[starts[at] : ends[to - 1]])])
        lists = [pa.ListArray.from_arrays(pa.array(cut[at : to + 1] - cut[at]), pa.array(x[cut[at] : cut[to]])) for x in (freqs, norms)]
        none = pa.nulls(to - at, pa.list_(pa.int64())), pa.nulls(to - at, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, shard)), names.take(pa.array(term[heads[row]])), pa.array(n[row].astype(np.int32)), pa.array(doc[heads[row]].astype(np.int32)), pa.array(doc[last[row]].astype(np.int32)), *lists, data, *none], schema=_TYPES)


class _Shard:
    """Postings of a shard while its documents arrive."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.postings = 0

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        term, doc, count, known = [], [], [], self.terms
        for i, text in zip(ids, texts, strict=True):
            words = terms_of(text) if text else []
            if not words:
                continue
            seen, counts = np.unique(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)), return_counts=True)
            term.append(seen)
            doc.append(np.full(len(seen), len(self.ids), np.int32))
            count.append(counts.astype(np.int32))
            self.ids.append(i)
            self.sizes.append(len(words))
            self.postings += len(seen)
        if term:
            self.parts.append((np.concatenate(term), np.concatenate(doc), np.concatenate(count)))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": self.ids, "sizes": self.sizes}], schema=_TYPES)
        yield from _blocks(shard, [t.decode() for t in self.terms], *(np.concatenate(x) for x in zip(*self.parts, strict=True)), np.array(self.sizes, np.int64))


def build_index(docs: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """docs: doc_id, text -> rows of posting blocks (term given) and one row a shard with its documents (term null). Write it once: a shard is
    the work of one task, so two runs over other splits make other shards."""
    most = cfg.postings

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, shard = TaskContext.get().partitionId() << 24, 0, _Shard()
        for batch in slices(batches):
            shard.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if shard.postings >= most:
                yield from shard.rows(base + done)
                done, shard = done + 1, _Shard()
        yield from shard.rows(base + done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, _SHARD_ROW)


class Searcher:
    """The blocks of one shard that the queries at hand need, unpacked as they are met."""

    def __init__(self, m: np.ndarray, term: list[str], n: np.ndarray, first: np.ndarray, last: np.ndarray, bound: np.ndarray, data: list[bytes]):
        self.m, self.n, self.first, self.last, self.bound, self.data = m, n, first, last, bound, data
        self.of: dict[str, list[int]] = {}
        for i, t in enumerate(term):
            self.of.setdefault(t, []).append(i)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.met = 0

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block i."""
        if i not in self.open:
            docs, count = unpack(self.data[i], int(self.n[i]), int(self.first[i]))
            self.open[i] = docs, impact(count, self.m[docs])
        return self.open[i]

    def best(self, query: list[tuple[str, int]], k: int) -> list[tuple[int, int]]:
        """The k best documents (place in the shard, score) with a score above 0, and all that equal the last of them."""
        held = [(i, w) for t, w in query if w > 0 for i in self.of.get(t, ())]
        if not held:
            return []
        which, weight = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        self.met += len(held)
        first, last, most = self.first[which], self.last[which], weight * self.bound[which]
        edges, back = np.unique(np.r_[first, last + 1], return_inverse=True)  # between two edges no pointer changes its block
        lo, hi = back[: len(which)], back[len(which) :]
        bounds = np.cumsum(np.bincount(lo, most, len(edges)) - np.bincount(hi, most, len(edges)))[:-1]  # whole numbers below 2**53, so exact
        order = np.argsort(-bounds, kind="stable")
        score, floor, at, step = np.zeros(len(self.m), np.int64), 1, 0, 4
        while at < len(order) and bounds[order[at]] >= floor:
            ranges = order[at : at + step]
            live = np.zeros(len(edges), np.int64)
            live[ranges[bounds[ranges] >= floor] + 1] = 1
            live = np.cumsum(live)
            for j in np.flatnonzero(live[hi] > live[lo]):  # only blocks that meet a range above the threshold are unpacked
                docs, gain = self.block(int(which[j]))
                if live[hi[j]] - live[lo[j]] < hi[j] - lo[j]:
                    r = np.searchsorted(edges, docs, "right")
                    some = live[r] > live[r - 1]
                    docs, gain = docs[some], gain[some]
                score[docs] += weight[j] * gain
            if np.count_nonzero(score) >= k:
                floor = max(1, int(np.partition(score, -k)[-k]))
            at, step = at + step, 4 * step
        found = np.flatnonzero(score >= floor)
        return [(int(d), int(score[d])) for d in found]


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part in a score before its weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def _rank(rows: pa.Table, queries: list[tuple[int, list[tuple[str, int]]]], n_docs: int, total: int, k: int) -> pa.Table:
    """Rows of one shard -> query, doc_id, score: at least its k best for each query."""
    own, blocks = rows.filter(rows["term"].is_null()), rows.filter(rows["term"].is_valid())
    flat = lambda table, c: table[c].combine_chunks().flatten()
    whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    length = lambda n: 25 + (75 * n * n_docs) // total
    out: list[tuple[int, int, int]] = []
    if blocks.num_rows:
        size = whole(pc.list_value_length(blocks["freqs"].combine_chunks()))
        bound = np.maximum.reduceat(impact(whole(flat(blocks, "freqs")), length(whole(flat(blocks, "norms")))), np.r_[0, np.cumsum(size)[:-1]])
        ints = lambda c: whole(blocks[c].combine_chunks())
        s = Searcher(length(whole(flat(own, "sizes"))), blocks["term"].to_pylist(), ints("n"), ints("first"), ints("last"), bound, blocks["data"].to_pylist())
        out = [(q, d, x) for q, terms in queries for d, x in s.best(terms, k)]
    query, doc, score = (pa.array([r[i] for r in out], pa.int64()) for i in range(3))
    return pa.table({"query": query, "doc_id": flat(own, "ids").take(doc), "score": score})


def _ranker(queries: list[tuple[int, list[tuple[str, int]]]], n_docs: int, total: int, k: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _rank(rows, queries, n_docs, total, k)


def _fold(text: str) -> F.Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """index: a written index; queries: id_col, text -> id_col, rank, doc_id, score."""
    spark: SparkSession = index.sparkSession
    scratch = Scratch(spark, "lexical")
    own = index.filter("term is null").selectExpr("size(ids) as n", "aggregate(sizes, 0L, (a, x) -> a + x) as total").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs, total = own.n or 0, own.total or 0
    rows = scratch.keep(queries.select(F.expr("uuid()").alias("key"), F.col(id_col).alias("id"), _fold("text").alias("terms")).filter("size(terms) > 0"), "queries")
    asked = rows.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("times"))
    words = scratch.keep(asked.select("term").distinct(), "terms")
    df = index.filter("term is not null").join(F.broadcast(words) if words.count() <= cfg.query_terms else words, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").groupBy("key").agg(F.collect_list(F.struct("term", (F.col("times") * weight).alias("w"))).alias("terms"))
    running = F.sum(F.size("terms")).over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    dealt = weighed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("pass", F.floor(running / max(1, cfg.query_terms // 64)))
    dealt = scratch.keep(dealt, "weights")
    found = None
    for p in sorted(r[0] for r in dealt.select("pass").distinct().collect()):
        some = sorted(dealt.filter(F.col("pass") == p).select("key", "terms").collect())
        keys, held = [r.key for r in some], [(i, [(t.term, t.w) for t in r.terms]) for i, r in enumerate(some)]
        words = spark.createDataFrame(sorted({(t,) for _, ts in held for t, _ in ts}), "term string")
        mine = index.join(F.broadcast(words), "term", "left_semi").unionByName(index.filter("term is null")).select("shard", "term", "n", "first", "last", "freqs", "norms", "data", "ids", "sizes")
        one = mine.groupBy("shard").applyInArrow(_ranker(held, n_docs, total, cfg.k), "query long, doc_id long, score long")
        named = one.join(F.broadcast(spark.createDataFrame(list(enumerate(keys)), "query long, key string")), "query").select("key", "doc_id", "score")
        top = named.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= cfg.k)
        top = scratch.keep(top, "ranks")
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], "id long, rank int, doc_id long, score long").select(F.col("id").cast(queries.schema[id_col].dataType).alias(id_col), "rank", "doc_id", "score")
    return found.join(rows.select("key", "id"), "key").select(F.col("id").alias(id_col), "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "item_id", cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Index ``docs`` and rank them for each query."""
    scratch = Scratch(docs.sparkSession, "lexical-index")
    return search(scratch.keep(build_index(docs), "index"), queries, id_col, cfg)
