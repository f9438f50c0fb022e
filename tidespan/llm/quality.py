"""Quality rules with risk-controlled cutoffs.

Every document gets exact counts over its whole text and a risk score from 0 to 1000. Labelled documents serve as the holdout:
within a stratum (``lang`` by default) cutoffs are tested from the most lenient downwards, and a cutoff is accepted as long as
the exact (Clopper-Pearson) upper bound on the share of good documents it rejects stays at or below ``alpha``. Testing stops at
the first cutoff that fails, so one level serves the whole sequence (fixed-sequence testing); the level is ``delta`` divided by
the number of strata (Bonferroni). With probability 1 - delta no stratum loses more than ``alpha`` of the good documents that pass its base rules;
good documents that the base rules reject are lost beside that. Among
the accepted cutoffs the one that rejects most labelled bad documents is used, the most lenient on ties. A stratum with too
few labels to prove anything keeps everything.

Nulls: a null text has no words, a null stratum is a stratum of its own, labels without doc_id or quality are left out,
several labels of one document count as its lowest. Repeated documents are judged row by row, but a labelled id is one trial however often it
stands, its riskiest row. Columns of the input keep their names and values, whatever they are called. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidespan.llm.scratch import Scratch, aside, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
STRUCT = "_quality_counts"
#: Strata up to which the table of cutoffs is broadcast (some 100 bytes a row); a shuffled join serves beyond.
BROADCAST_STRATA = 50_000
#: Labelled ids up to which their list is broadcast (8 bytes each), so that texts stay where they are; a shuffled semi-join serves beyond.
BROADCAST_LABELS = 1_000_000


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    alpha: float = 0.02
    delta: float = 0.05
    step: int = 10
    stratum: str = "lang"


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    k = len(ids)
    pair = w[:-1] * k + w[1:]
    if k >= 2_000_000:  # three codes would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, times = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one text; bytes.split() takes exactly [\\x20\\x09-\\x0D] as space."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - len(raw) + sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines)


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])
    for batch in slices(batches):
        rows = [text_counts(x) for x in batch.column("text").to_pylist()]
        made = pa.StructArray.from_arrays([pa.array((r[i] for r in rows), pa.int64()) for i in range(len(COUNTS))], fields=list(kind)) if rows else pa.array([], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, STRUCT])


def with_counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and a struct of the counts."""
    schema = T.StructType([*docs.schema.fields, T.StructField(STRUCT, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.mapInArrow(_append, schema)


def base_failed(cfg: QualityConfig) -> F.Column:
    return (F.col(f"{STRUCT}.n_words") < cfg.min_words) | (100 * F.col(f"{STRUCT}.n_repeat_words") > cfg.max_repeat_percent * F.col(f"{STRUCT}.n_words"))


def risk_score() -> F.Column:
    """0 (clean) to 1000: half symbols a word, a quarter repeated lines, a quarter repeated words. Integer, so that every engine agrees."""
    q = lambda c: F.col(f"{STRUCT}.{c}")
    words, lines = F.greatest(q("n_words"), F.lit(1)), F.greatest(q("n_lines"), F.lit(1))
    return (F.expr(f"least({STRUCT}.n_symbols, {STRUCT}.n_words)") * 500 / words + q("n_dup_lines") * 250 / lines + q("n_repeat_words") * 250 / words).cast("int")


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper bound at confidence 1 - delta on a rate of which k of n trials were seen."""
    if n <= 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        return math.fsum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > delta else (low, mid)
    return high


def choose_cutoff(good: np.ndarray, bad: np.ndarray, delta: float, cfg: QualityConfig) -> int | None:
    """good, bad: labelled documents by score 0..1000. The cutoff in use (a score at or above it is rejected), or None."""
    n, best, most = int(good.sum()), None, 0
    above_good, above_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    for c in range(1000, 0, -cfg.step):
        if above_good[c] > cfg.alpha * n or binomial_upper(int(above_good[c]), n, delta) > cfg.alpha:
            break
        if above_bad[c] > most:
            best, most = c, int(above_bad[c])
    return best


def cutoffs(labelled: DataFrame, cfg: QualityConfig) -> DataFrame:
    """labelled: stratum, score, quality -> stratum, cutoff, for strata where one is proven. Reads counts only: 1001 rows a stratum at most."""
    counts = labelled.groupBy("stratum", "score").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    strata = max(1, counts.select("stratum").distinct().count())

    def solve(pdf):
        good, bad = np.zeros(1001, np.int64), np.zeros(1001, np.int64)
        np.add.at(good, pdf["score"].to_numpy(), pdf["good"].to_numpy())
        np.add.at(bad, pdf["score"].to_numpy(), pdf["bad"].to_numpy())
        cut = choose_cutoff(good, bad, cfg.delta / strata, cfg)
        out = pdf[["stratum"]].head(1).copy()
        out["cutoff"] = 1001 if cut is None else cut
        return out

    return counts.groupBy("stratum").applyInPandas(solve, "stratum string, cutoff int").filter("cutoff <= 1000")


def _stratum(df: DataFrame, cfg: QualityConfig) -> F.Column:
    return F.coalesce(F.col(cfg.stratum).cast("string"), F.lit("\x00null")) if cfg.stratum in df.columns else F.lit("\x00all")


def _fit(counted: DataFrame, labels: DataFrame, cfg: QualityConfig, scratch: Scratch) -> tuple[DataFrame, int]:
    """counted: doc_id, stratum and the counts."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = counted.filter(~base_failed(cfg)).select("doc_id", "_stratum", risk_score().alias("score")).join(known, "doc_id")
    once = held.groupBy("doc_id").agg(F.max(F.struct("score", "_stratum")).alias("worst"), F.first("quality").alias("quality"))  # a repeated id is one trial, its riskiest row
    held = once.select(F.col("worst._stratum").alias("stratum"), F.col("worst.score").alias("score"), "quality")
    cut = scratch.keep(cutoffs(held, cfg), "cutoffs")
    return cut, cut.count()


def _judge(df: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    side = cut.select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_cutoff"))
    return df.join(F.broadcast(side) if n <= BROADCAST_STRATA else side, "_stratum", "left")


def quality_verdicts(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per document: the counts, base_failed, the score, the cutoff of its stratum and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    narrow = docs.select("doc_id", "text", _stratum(docs, cfg).alias("_stratum"))
    counted = scratch.keep(with_counts(narrow).drop("text"), "counts")
    judged = _judge(counted, *_fit(counted, labels, cfg, scratch))
    failed, score = base_failed(cfg), risk_score()
    return judged.select(
        "doc_id", *[F.col(f"{STRUCT}.{c}").alias(c) for c in COUNTS[:5]], failed.alias("base_failed"),
        (~failed & ~F.coalesce(score >= F.col("_cutoff"), F.lit(False))).alias("kept"), score.alias("risk"), F.col("_cutoff").alias("cutoff"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that are kept, with the columns they came with. Cutoffs are fitted on the labelled documents alone, so texts pass once."""
    scratch = Scratch(docs.sparkSession, "quality")
    docs, back = aside(docs)
    cfg = replace(cfg, stratum={v: k for k, v in back.items()}.get(cfg.stratum, cfg.stratum))
    known = scratch.keep(labels.select("doc_id").filter("doc_id is not null").distinct(), "labelled")
    held = docs.select("doc_id", "text", _stratum(docs, cfg).alias("_stratum")).join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id", "left_semi")
    cut, n = _fit(scratch.keep(with_counts(held).drop("text"), "counts"), labels, cfg, scratch)
    judged = _judge(with_counts(docs).withColumn("_stratum", _stratum(docs, cfg)), cut, n)
    return judged.filter(~base_failed(cfg) & ~F.coalesce(risk_score() >= F.col("_cutoff"), F.lit(False))).select(*docs.columns).withColumnsRenamed(back)
