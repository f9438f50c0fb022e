"""Secret scans, in DataFrame functions only.

Fixed rules find assignments, access keys and hex strings. Two first-order character Markov models, one of random strings and one
of ordinary identifiers, find further tokens: a run of 20 or more characters from the token alphabet, with a digit and a letter,
is a secret if the mean log-likelihood ratio of its transitions and their sum exceed their thresholds. Both models are trained
from labelled samples (``token``, ``label``); ``samples`` makes them from generated random strings and from words of a bounded
sample of documents, joined the ways identifiers are.

Positions are code points, the end exclusive. A rule's matches are leftmost and do not overlap; those of different rules may. Model
spans that overlap a rule's span are dropped. Null or empty texts have no spans. Rows are judged one by one, so repeated rows and
ids are kept. Without samples the models are even and find nothing. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.scratch import aside

#: The rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_GROUP, ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 2, 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_RUN}])[{_RUN}]{{20,}}+"


@dataclass(frozen=True)
class SecretConfig:
    mean_ratio: float = 0.6
    least_ratio: float = 15.0
    sample_docs: int = 2000
    sample_strings: int = 6000
    smoothing: float = 0.5


def samples(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """token, label (1 random, 0 ordinary). Reads at most ``sample_docs`` documents, those whose ids and texts hash lowest."""
    spark = docs.sparkSession
    seed = spark.range(cfg.sample_strings).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    made = seed.select(F.explode(F.array("h", b64, F.upper(F.substring("h", 1, 40)), F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 32))).alias("token")).withColumn("label", F.lit(1))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    least = keyed.select("key").distinct().orderBy("key").limit(cfg.sample_docs)  # keys alone are gathered, texts stay where they are
    some = keyed.join(F.broadcast(least), "key", "left_semi")
    words = some.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,}+(?![A-Za-z0-9])"), F.lit(0)).alias("w"))
    joins = "explode(flatten(transform(sequence(1, greatest(size(w) - 2, 1)), i -> array(array_join(slice(w, i, 3), '_'), array_join(transform(slice(w, i, 2), x -> initcap(x)), ''), concat(get(w, i - 1), '-', cast(i % 100 as string))))))"
    return made.union(words.filter("size(w) > 0").select(F.expr(joins).alias("token")).withColumn("label", F.lit(0)))


def train(labelled: DataFrame, cfg: SecretConfig = SecretConfig()) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row in the order of ALPHABET: a table of fixed size."""
    k = len(ALPHABET)
    chars = labelled.filter("token is not null and label is not null").select("label", F.split("token", "").alias("c"))
    pairs = chars.select("label", F.explode(F.expr("zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> concat(a, b))")).alias("p"))
    rows = pairs.filter(F.col("p").rlike(f"^[{_RUN}]{{2}}$")).groupBy("label", "p").count().collect()  # at most 2 * 67 * 67 rows
    tally = {0: [[cfg.smoothing] * k for _ in range(k)], 1: [[cfg.smoothing] * k for _ in range(k)]}
    for r in rows:
        if r.label in tally:
            tally[r.label][ALPHABET.index(r.p[0])][ALPHABET.index(r.p[1])] += r["count"]
    return [math.log(tally[1][i][j] / sum(tally[1][i])) - math.log(tally[0][i][j] / sum(tally[0][i])) for i in range(k) for j in range(k)]


def _places(pattern: str, kind: int, extra: str = "true", group: int = 0) -> str:
    """SQL for the array of (start, kind, end, value) of a pattern's matches. What lies between matches comes from split, so positions are sums of lengths."""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    zipped = f"arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group}))"
    gap, end = "a.pos + length(x.`0`)", "a.pos + length(x.`0`) + length(x.`1`)"
    step = f"(a, x) -> if(x.`1` is null, a, named_struct('pos', {end}, 'out', if({extra}, concat(a.out, array(named_struct('start', {gap}, 'kind', {kind}, 'end', {end}, 'value', x.`1`))), a.out)))"
    none = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"
    return f"if(text rlike {p}, aggregate({zipped}, named_struct('pos', 0, 'out', {none}), {step}, a -> a.out), {none})"


def scan(docs: DataFrame, ratios: list[float], cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """All columns of ``docs``, then ``_base`` and ``_found``: arrays of (start, kind, end), the rules' spans and all spans, in order."""
    k, a = len(ALPHABET), "'" + ALPHABET + "'"
    table = "array(" + ",".join(f"{x:.6f}D" for x in ratios) + ")"
    likely = f"zip_with(slice(split(x.value, ''), 1, length(x.value) - 1), slice(split(x.value, ''), 2, length(x.value) - 1), (p, q) -> get({table}, (locate(p, {a}) - 1) * {k} + locate(q, {a}) - 1))"
    total = f"aggregate({likely}, 0D, (s, y) -> s + y)"
    cols = docs.columns
    rules = docs.withColumn("_original", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    rules = rules.withColumn("_assign", F.expr(_places(ASSIGN, 0, f"length(x.`2`) >= {ASSIGN_LEAST}", ASSIGN_GROUP)))
    rules = rules.withColumn("_access", F.expr(_places(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), 1)))
    rules = rules.withColumn("_hex", F.expr(_places(r"(?<![0-9a-f])[0-9a-f]{%d,}+" % HEX_LEAST, 2)))
    rules = rules.withColumn("_token", F.expr(_places(CANDIDATE, 3, "x.`1` rlike '[0-9]' and x.`1` rlike '[A-Za-z]'")))
    rules = rules.withColumn("_base", F.expr("array_sort(transform(concat(_assign, _access, _hex), x -> struct(x.start as start, x.kind as kind, x.end as end)))"))
    keep = f"filter(filter(_token, x -> not exists(_base, y -> y.start < x.end and x.start < y.end)), x -> {total} > greatest({cfg.least_ratio}D, {cfg.mean_ratio}D * (length(x.value) - 1)))"
    rules = rules.withColumn("_found", F.expr(f"if(size(_token) = 0, _base, array_sort(concat(_base, transform({keep}, x -> struct(x.start as start, x.kind as kind, x.end as end)))))"))
    return rules.withColumn("text", F.col("_original")).select(*cols, "_base", "_found")


def _joined(spans: str) -> F.Column:
    kinds = "array(" + ", ".join(f"'{x}'" for x in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({kinds}, x.kind), ':', x.start, ':', x.end)), ',')")


def secret_report(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = scan(docs.select("doc_id", "text"), train(samples(docs, cfg), cfg), cfg)
    count = lambda i: F.expr(f"cast(size(filter(_base, x -> x.kind = {i})) as bigint)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_found").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars``, where there is one, follows the text."""
    docs, back = aside(docs)
    found = scan(docs, train(samples(docs, cfg), cfg), cfg)
    step = f"(a, x) -> if(x.end <= a.pos, a, named_struct('pos', x.end, 'out', concat(a.out, if(x.start > a.pos, concat(substring(text, a.pos + 1, x.start - a.pos), '{mark}'), if(x.start = a.pos, '{mark}', '')))))"
    clean = F.expr(f"if(size(_found) = 0, text, aggregate(_found, named_struct('pos', 0, 'out', ''), {step}, a -> concat(a.out, substring(text, a.pos + 1))))")
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).withColumnsRenamed(back)
