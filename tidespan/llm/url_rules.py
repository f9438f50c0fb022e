"""URL filters: fixed host and path rules, then association rules mined from labels, in DataFrame functions only.

The labels are those of URLs: a page is bad if a fixed rule blocks it, any other counts as good, and a caller may pass labels of pages by
their ids. (Labels of documents say nothing of pages, whose ids are numbers of another kind.) Rules carry the outcome over to pages
that no fixed rule reaches.

A URL becomes a set of tokens (scheme, host parts, parts of host names, path, query and fragment). The tokens of labelled pages with
the outcome as one more token are the transactions; Spark's FP-growth mines the token combinations that are frequent together with the
bad outcome, from the bad pages (no token is left out but for its own support there, which bounds that of all its combinations), and they
are counted among all labelled pages. Rules whose consequent is the bad outcome are kept if their support, confidence and lift suffice,
if chance does not explain them, and if no shorter rule inside them is as confident (pruning). For the last but one, the Chernoff bound
of the binomial tail, which never understates the p-value (n pages, a share s of them bad, base share b: exp(-n KL(s, b))), times the number of token sets
mined (Bonferroni) must not exceed alpha. Where all labelled pages are bad nothing differs from chance and no rule is kept. Tokens of the same labelled pages are one item, which a URL has if it has any
of them: a rule with two of them would be pruned. Rules are matched by an inverted index: each rule is entered under its rarest item, a
URL looks its tokens up and the rest of a rule's items is checked on the URL's own set. A page takes the verdict of its longest fixed
rule, else ``block`` if a mined rule matches, else ``allow``.

URLs are judged once each, however often they occur. Null URLs and URLs without ``://`` have an empty host and path, fit no fixed rule
and are judged by what tokens they have. Where no page is bad nothing is mined and all such pages are allowed. Repeated rows stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.decontaminate import ascii_lower
from tidespan.llm.scratch import Scratch

#: Host, path and verdict of the rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[tuple[str, str, str], ...] = RULES
    support: float = 0.002
    least_pages: int = 20  # bad pages that a rule needs, whatever the support
    alpha: float = 0.01
    confidence: float = 0.75
    lift: float = 2.0
    longest: int | None = None  # items in a rule; no bound if None


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path)."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def fixed_rule(cfg: UrlConfig) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(cfg.rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens() -> F.Column:
    """Distinct tokens of ``url``, ``host`` and ``path``, told apart by where they stand."""
    named = lambda tag, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    low = ascii_lower(F.coalesce("url", F.lit("")))
    host = F.split("host", r"\.")
    return F.array_distinct(F.concat(
        named("scheme:", F.array(F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1))), named("host:", F.array("host")), named("label:", host), named("part:", F.flatten(F.transform(host, lambda x: F.split(x, "-")))),
        named("dir:", F.filter(F.split(ascii_lower(F.col("path")), "[/._-]"), lambda x: ~x.rlike("^[0-9]*$"))), named("query:", F.split(F.regexp_extract(low, r"\?([^#]*)", 1), "[&=;]")), named("at:", F.array(F.regexp_extract(low, "#(.*)", 1))),
    ))


def least_confidence(base: float, cfg: UrlConfig) -> float:
    """The confidence a rule needs: the share of bad pages times the lift, or the share of good pages divided by it, whichever is met first; never above 1."""
    return max(cfg.confidence, min(cfg.lift * base, 1 - (1 - base) / cfg.lift))


def _under_rarest(sets: DataFrame, items: DataFrame) -> DataFrame:
    """sets with ``anchor``, the rarest of their ``tokens``."""
    rarest = sets.select("tokens", F.explode("tokens").alias("item")).join(items.select("item", "n"), "item").groupBy("tokens").agg(F.min(F.struct("n", "item")).alias("m"))
    return sets.join(rarest, "tokens").withColumn("anchor", F.col("m.item")).drop("m")


def mine(labelled: DataFrame, cfg: UrlConfig, scratch: Scratch) -> DataFrame:
    """labelled: tokens, bad -> items (arrays of interchangeable tokens), anchor (one of the rarest item's tokens), confidence, support: at most 1/support frequent tokens a place take part."""
    rows = scratch.keep(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = rows.count()
    base = rows.agg(F.avg("bad")).first()[0] or 0.0
    least = max(cfg.least_pages, math.ceil(cfg.support * total))
    each = rows.select("row", F.explode("tokens").alias("t"), "bad").groupBy("t").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), *[F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"x{i}") for i in (1, 2)])
    # what all labelled pages have lifts nothing, and a rule is as confident without it
    useful = each.filter((F.col("bad") >= least) & (F.col("n") < total))
    items = scratch.keep(useful.groupBy("n", "bad", "x1", "x2").agg(F.array_sort(F.collect_list("t")).alias("any")).select(F.col("any")[0].alias("item"), "any", "n"), "items")
    if base >= 1.0 or items.isEmpty():
        return scratch.keep(labelled.select(F.array("tokens").alias("items"), F.lit("").alias("anchor"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0), "rules")
    have = rows.select("row", "bad", F.explode("tokens").alias("item")).join(items.select("item"), "item").groupBy("row", "bad").agg(F.array_sort(F.collect_set("item")).alias("have"))
    have = scratch.keep(have.groupBy("have", "bad").agg(F.count("*").alias("n")), "transactions")
    bad = have.filter("bad = 1").select(F.explode(F.array_repeat("have", F.col("n").cast("int"))).alias("items"))
    # minSupport is a share that is multiplied and rounded up again: half a page less is exact
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / bad.count())).fit(bad)
    frequent = model.freqItemsets.filter(F.lit(True) if cfg.longest is None else F.size("items") <= cfg.longest).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad"))
    frequent = scratch.keep(_under_rarest(frequent, items), "frequent")
    met = have.select("have", "n", F.explode("have").alias("anchor")).join(frequent.select("tokens", "anchor"), "anchor").filter(F.forall("tokens", lambda t: F.array_contains(F.col("have"), t)))
    counts = met.groupBy("tokens").agg(F.sum("n").alias("n"))
    rules = frequent.join(counts, "tokens").select("tokens", "anchor", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / total).alias("support"))
    good, s = 1 - base, F.col("confidence")
    nats = s * F.log(s / base) + F.when(s < 1, (1 - s) * F.log((1 - s) / good)).otherwise(0.0)
    beyond_chance = F.round(F.col("support") * total) / s * nats >= math.log(max(1, frequent.count()) / cfg.alpha)
    rules = scratch.keep(rules.filter((s >= least_confidence(base, cfg)) & (s > base) & beyond_chance), "mined")
    # a rule is pruned if one of its one-token-shorter rules is as confident
    shorter = rules.filter("size(tokens) > 1").select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("inner"))
    beaten = shorter.join(rules.select(F.col("tokens").alias("inner"), F.col("confidence").alias("c")), "inner").groupBy("tokens").agg(F.max("c").alias("c"))
    pruned = rules.join(beaten, "tokens", "left").filter("c is null or confidence > c").select("tokens", "anchor", "confidence", "support")
    named = pruned.select("tokens", F.explode("tokens").alias("item")).join(items, "item").groupBy("tokens").agg(F.array_sort(F.collect_list("any")).alias("items"))
    out = pruned.join(named, "tokens").join(items.select(F.col("item").alias("anchor"), "any"), "anchor")
    return scratch.keep(out.select("items", F.explode("any").alias("anchor"), "confidence", "support"), "rules")


def judge(pages: DataFrame, labels: DataFrame | None = None, cfg: UrlConfig = UrlConfig()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, then the best mined rule's confidence and tokens (null if none matches).

    labels: page_id, bad (0 or 1), pages' own labels; where given, rules are mined from these pages alone.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(cfg)
    open_ = rows.withColumn("rule", rule).withColumn("fixed", verdict)
    told = open_.withColumn("own", F.lit(None).cast("int"))
    if labels is not None:
        own = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("own"))
        told = open_.join(own, "page_id")
    bad = F.coalesce("own", F.coalesce(F.col("fixed") == "block", F.lit(False)).cast("int"))
    rules = mine(told.withColumn("bad", bad).filter("url is not null").select(url_tokens().alias("tokens"), "bad"), cfg, scratch)
    # inverted index: the URLs that no fixed rule decides look up the rules entered under their tokens
    urls = open_.filter("fixed is null and url is not null").select("url", "host", "path").distinct().select("url", url_tokens().alias("have"))
    met = urls.select("url", "have", F.explode("have").alias("anchor")).join(rules, "anchor").filter(F.forall("items", lambda i: F.arrays_overlap(F.col("have"), i)))
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", F.array_join(F.transform("items", lambda i: F.array_min(F.array_intersect(i, F.col("have")))), " ").alias("mined"))).alias("b"))
    out = open_.join(scratch.keep(best, "matched"), "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("b").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("b.confidence")).alias("confidence"), F.when(F.col("fixed").isNull(), F.col("b.mined")).alias("mined_rule"))
