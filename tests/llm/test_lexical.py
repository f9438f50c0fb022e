"""Ranked search against brute force; blocks against what was put in them."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.llm import lexical
from tidespan.llm.scratch import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    nn, ll = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(FOLD)))
        scores = []
        for i, b, n in bags:
            m = 25 + (75 * n * nn) // ll
            s = sum(c * math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in asked.items() if b[t])
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def texts(rng, n, words=60, most=80):
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "ÉTÉ", "ß", "日本", "A1"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    return ["".join(w + rng.choice([" ", "-", "\n", "_"]) for w in rng.choices(vocabulary, odds, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("postings", [300, 4_000_000])
def test_against_brute_force(spark, docs_of, postings):
    rng = random.Random(postings)
    found = texts(rng, 400)
    docs = [*enumerate(found), (5, found[5]), (None, found[7]), (900, None), (901, ""), (902, " .,"), (903, found[9]), (904, "w1 " * 70_000), (905, found[9])]
    items = [*enumerate(texts(rng, 25)), (3, "w3 w3 w3"), (None, "w1 w2 ß"), (50, None), (51, ""), (52, "absent"), (53, "w0 " * 200 + "日本")]
    df, qs = docs_of(docs), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("term", F.lit("x"))
    index = Scratch(spark, "t").keep(lexical.build_index(df, lexical.IndexConfig(postings=postings)), "index")
    for most in (200_000, 640):
        got = lexical.search(index, qs, cfg=lexical.SearchConfig(query_terms=most))
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    some, none = docs_of([(1, "a b")]), docs_of([(1, "a")]).limit(0)
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(none, q).count() == 0 and lexical.ranked(some, q.limit(0)).count() == 0 and lexical.ranked(docs_of([(1, None)]), q).count() == 0


def test_blocks_hold_their_postings():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 100_000, 3000)
    term, doc, count = [], [], []
    for t, share in enumerate((1.0, 0.3, 0.01, 0.001)):
        d = np.flatnonzero(rng.random(3000) < share)
        term.append(np.full(len(d), t, np.int32)), doc.append(d.astype(np.int32)), count.append(rng.choice([1, 2, 300, 70_000], len(d)).astype(np.int32))
    term, doc, count = map(np.concatenate, (term, doc, count))
    mixed = rng.permutation(len(term))
    back = {}
    for batch in lexical._blocks(7, ["a", "b", "c", "d"], term[mixed], doc[mixed], count[mixed], sizes):
        for r in batch.to_pylist():
            docs, times = lexical.unpack(r["data"], r["n"], r["first"])
            assert docs[0] == r["first"] and docs[-1] == r["last"] and r["n"] <= lexical.BLOCK
            back.setdefault(r["term"], []).extend(zip(docs.tolist(), times.tolist(), strict=True))
            m = lambda n: 25 + (75 * n * 3000) // int(sizes.sum())
            assert lexical.impact(times, m(sizes[docs])).max() == lexical.impact(np.array(r["freqs"]), m(np.array(r["norms"]))).max()
    for t, name in enumerate("abcd"):
        assert back.get(name, []) == list(zip(doc[term == t].tolist(), count[term == t].tolist(), strict=True))


def test_ranges_below_the_threshold_stay_packed():
    """Ten documents hold the rare term; the blocks of the common one that hold none of them are never unpacked."""
    n = 128 * 200
    sizes = np.full(n, 100)
    common, rare = np.arange(n), np.arange(10) * 13
    parts = np.r_[np.zeros(n, np.int32), np.ones(10, np.int32)], np.r_[common, rare].astype(np.int32), np.ones(n + 10, np.int32)
    rows = [r for b in lexical._blocks(0, ["common", "rare"], *parts, sizes) for r in b.to_pylist()]
    m = np.full(n, 100)
    bound = np.array([lexical.impact(np.array(r["freqs"]), m[: len(r["freqs"])]).max() for r in rows])
    s = lexical.Searcher(m, [r["term"] for r in rows], *(np.array([r[c] for r in rows]) for c in ("n", "first", "last")), bound, [r["data"] for r in rows])
    best = s.best([("common", 5), ("rare", 5000)], 10)
    assert sorted(d for d, _ in best) == rare.tolist() and len(s.open) <= 5 and s.met == 201
