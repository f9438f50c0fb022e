"""Preferences, mixing, URL rules, extraction, WARC, the Jaccard join and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidespan.llm import extract, jaccard, mixing, preferences, url_rules, warc

# preferences


def test_pairs_share_their_prompt_and_mask_answers(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "assistant", "no"), (3, 0, "user", "alone"), (3, 1, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, pair string")
    got = {r.chosen_id: r for r in preferences.preferences(df).collect()}
    assert set(got) == {1, 3} and (got[1].rejected_id, got[1].n_common) == (2, 3) and got[3].rejected is None
    for text, mask, want in ((got[1].chosen, got[1].chosen_mask, ["long answer"]), (got[1].rejected, got[1].rejected_mask, ["no"])):
        assert [text[m.start : m.end] for m in mask] == want
    assert got[1].prompt.count("<|im_start|>") == 3 and preferences.preferences(df.limit(0)).isEmpty()


def test_a_shared_opening_is_dealt_over_blocks(spark):
    df = spark.range(50).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'same' as text")
    out = preferences.preferences(df, preferences.ChatConfig(block=10)).collect()
    ids = [x for r in out for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(ids) == list(range(50)) and all(r.n_common == 1 for r in out if r.rejected_id is not None)


def test_conversations_without_a_shared_opening_are_paired(spark):
    rows = [(i, 0, "user", f"question {i // 3 if i < 6 else i}") for i in range(41)] + [(i, 1, "assistant", f"answer {i}") for i in range(41)]
    out = preferences.preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), preferences.ChatConfig(block=4)).collect()
    ids = [x for r in out for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(ids) == list(range(41)) and sum(r.rejected_id is None for r in out) == 1
    for r in out:
        if r.rejected_id is not None:
            same = r.chosen_id < 6 and r.rejected_id < 6 and r.chosen_id // 3 == r.rejected_id // 3
            assert r.n_common == int(same) and (r.prompt == "") == (not same)
            assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == [f"answer {r.chosen_id}"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == [f"answer {r.rejected_id}"]
    assert sum(r.n_common == 1 for r in out if r.rejected_id is not None) == 2


def brute_pair(a, b, cfg):
    """(n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) by a loop over turns, texts appended turn by turn."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def render(turns):
        text, mask = "", []
        for role, said in turns:
            text += cfg.begin + role + "\n"
            if role == cfg.trained:
                mask.append((len(text), len(text) + len(said)))
            text += said + cfg.end
        return text, mask

    return n, render(a[:n])[0], *render(a[n:]), *render(b[n:])


def test_pairs_match_brute_force(spark):
    """Random turns with ties, nulls, equal conversations, one a prefix of the other, astral characters and a very long text."""
    rng, convs = random.Random(8), {}
    for i in range(60):
        convs[i] = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "q\U0001f600"])) for _ in range(rng.randint(1, 5))]
    convs[60], convs[61] = convs[0], convs[0][:1]
    convs[62] = [*convs[0], ("assistant", "y" * 300_000)]
    rows = [(i, k, r, t) for i, c in convs.items() for k, (r, t) in enumerate(c)]
    cfg, clean = preferences.ChatConfig(block=4), {i: [(r or "", t or "") for r, t in c] for i, c in convs.items()}
    got = preferences.preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), cfg).collect()
    ids = [x for r in got for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(ids) == sorted(convs) and sum(r.rejected_id is None for r in got) == 1
    weight = lambda i: sum(len(t) for r, t in clean[i] if r == "assistant")
    for r in (x for x in got if x.rejected_id is not None):
        mask = lambda m: [(x.start, x.end) for x in m]
        assert (r.n_common, r.prompt, r.chosen, mask(r.chosen_mask), r.rejected, mask(r.rejected_mask)) == brute_pair(clean[r.chosen_id], clean[r.rejected_id], cfg)
        assert (-weight(r.chosen_id), r.chosen_id) < (-weight(r.rejected_id), r.rejected_id)


def test_blocks_of_one_opening_go_to_many_tasks(spark, monkeypatch):
    from tidespan.llm.scratch import Scratch

    df = spark.range(4000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'same' as text")
    for bound in (100_000, 0):
        monkeypatch.setattr(preferences, "BROADCAST_OPENINGS", bound)
        placed = {}
        keep = Scratch.keep
        monkeypatch.setattr(Scratch, "keep", lambda self, x, name, placed=placed, keep=keep: placed.setdefault(name, x) is None or keep(self, x, name))
        preferences.preferences(df, preferences.ChatConfig(block=100))
        monkeypatch.setattr(Scratch, "keep", keep)
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        parts = [r["count"] for r in placed["placed"].groupBy(F.spark_partition_id()).count().collect()]
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sum(parts) == 4000 and max(parts) < 2000


# mixing


@pytest.mark.parametrize("good,bad,draws", [(3, 4, 5), (30, 50, 20), (1, 900, 450), (0, 5, 2), (7, 0, 3)])
def test_hypergeometric_draws(good, bad, draws):
    from math import comb

    u = (np.arange(4000) + 0.5) / 4000
    got = np.bincount([mixing.hypergeometric(good, bad, draws, x) for x in u], minlength=good + 1) / 4000
    want = [comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if draws >= k else 0 for k in range(good + 1)]
    assert np.abs(got - want).max() < 1e-3


def test_draws_of_any_size():
    slots, cfg = np.array([4 * 10**10, 0, 10**9, 7]), mixing.MixConfig()
    shards = -(-int(slots.sum()) // cfg.shard_slots)
    a, b = (mixing.shard_counts(s, slots, shards, cfg) for s in (5_000_000, 5_000_001))
    assert a[0].sum() == cfg.shard_slots and (a[1] + a[0] == b[1]).all() and abs(a[1][0] / a[1].sum() - slots[0] / slots.sum()) < 1e-4


def brute_mix(rows, sources, cfg):
    """Words taken of each (doc_id, text), by a loop over all slots and blocks as lists."""
    names = sorted({s for s in sources if s is not None}) + [None] * (None in sources)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(size(t) for (_, t), s in zip(rows, sources) if s == n) for n in names]
    goals = mixing.targets(sizes, cfg)
    plans = [mixing.source_plan(i, s, g, cfg) for i, (s, g) in enumerate(zip(sizes, goals))]
    counts = np.array([p.slots for p in plans])
    shards = max(1, -(-int(counts.sum()) // cfg.shard_slots))
    return names, sizes, goals, plans, [mixing.shard_counts(k, counts, shards, cfg) for k in range(shards)]


def test_mix_matches_a_loop(docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 5, 70])))) for i in range(60)] + [(99, "z " * 5000), (98, None)]
    sources = [rng.choice(["a", "b", None]) for _ in rows]
    cfg = mixing.MixConfig(block=8, shard_slots=16)
    mix = mixing.Mix(docs_of(rows, sources), cfg)
    names, sizes, goals, plans, shards = brute_mix(rows, sources, cfg)
    stream = {n: [] for n in names}  # the document of every word, in the order that the operator gave the documents
    for r in sorted(mix.placed().collect(), key=lambda r: (r.source_ix, r.off)):
        assert r.off == len(stream[names[r.source_ix]])
        stream[names[r.source_ix]] += [r.doc_id] * r["size"]
    taken = defaultdict(int)
    for here, before in shards:
        for s in range(len(names)):
            for rank in range(before[s], before[s] + here[s]):
                epoch, i = divmod(int(rank), plans[s].blocks)
                block = int(mixing.Permutation(plans[s].blocks, mixing._key(cfg, s, epoch))(np.array([i]))[0])
                words = stream[names[s]][block * 8 : block * 8 + 8]
                for d in words[: plans[s].last] if rank == plans[s].slots - 1 else words:
                    taken[d] += 1
    got = mix.digest().collect()
    assert {r.doc_id: r.taken for r in got} == {d: taken[d] for d, _ in rows}
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(s, round(g, 6)) for s, g in zip(sizes, goals)}


@settings(max_examples=60, deadline=None, derandomize=True, database=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12))
def test_targets_fill_the_share(sizes):
    t = mixing.targets(sizes, mixing.MixConfig())
    assert abs(sum(t) - 1.5 * sum(sizes)) <= 1e-6 * max(1, sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))


@settings(max_examples=40, deadline=None, derandomize=True, database=None)
@given(st.integers(1, 3000), st.integers(0, 2**62))
def test_permutations(n, key):
    p = mixing.Permutation(n, key)
    x = np.arange(n)
    assert sorted(p(x).tolist()) == x.tolist() and (p.inverse(p(x)) == x).all()


@settings(max_examples=60, deadline=None, derandomize=True, database=None)
@given(st.integers(1, 2000), st.floats(0, 2))
def test_plans_give_the_target(size, share):
    cfg = mixing.MixConfig(block=16)
    plan = mixing.source_plan(3, size, share * size, cfg)
    total = 0
    for r in range(plan.slots):
        e, i = divmod(r, plan.blocks)
        b = mixing.Permutation(plan.blocks, mixing._key(cfg, 3, e))(np.array([i]))
        total += plan.last if r == plan.slots - 1 else int(plan.length(b, 16)[0])
    assert total == min(int(share * size + 0.5), 2 * size)


def test_shards_split_the_slots():
    cfg, slots = mixing.MixConfig(shard_slots=10), np.array([33, 7, 0, 25])
    parts = [mixing.shard_counts(s, slots, 7, cfg) for s in range(7)]
    assert (sum(p[0] for p in parts) == slots).all() and all(p[0].sum() == 10 for p in parts[:-1])
    run = np.zeros(4, int)
    for here, before in parts:
        assert (before == run).all()
        run = run + here


def test_mix_of_documents(docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90)))) for i in range(120)] + [(500, None), (501, ""), (7, "x y"), (7, "x y")]
    sources = [rng.choice(["a", "b", "é", None]) for _ in rows]
    docs = docs_of(rows, sources)
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - k[1]) <= 1 for k, v in by.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_digest(docs.repartition(3)).collect()), key=str)
    assert mixing.mix_digest(docs.limit(0)).isEmpty()


def test_packed_texts_hold_what_was_taken(docs_of):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(30 + i))) for i in range(20)]
    docs = docs_of(rows, ["a" if i % 2 else "b" for i in range(20)])
    mix = mixing.Mix(docs, mixing.MixConfig(block=16))
    words = [w for r in mix.texts().collect() for w in r.text.split()]
    assert len(words) == sum(r.taken for r in mix.digest().collect())
    assert all(len(r.text.split()) <= 16 for r in mix.texts().collect())


# URL rules


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://Example.COM/en/x", "https://www.example.com/en/1?q#f", "http://a.www.example.com/en/", "http://example.com", "http://x.net/es/1", "http://net/fr/", "http://internet/es/", "https://É.com/a", "a://b://c/d", "http://x.org#top"]


def test_fixed_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule string")
    got = url_rules.judge(pages, spark.createDataFrame([], "page_id long, bad int"))
    for r in got.collect():
        host, path, rule, verdict = brute_rule([*URLS, *URLS][r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert got.count() == 2 * len(URLS)


def test_mined_rules_block_what_labels_say(spark):
    rows = [(i, f"http://{'free-bets' if i % 5 == 0 else 'news'}.site{i % 3}.org/p/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(300)], "page_id long, bad int, n int")
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all((got[i].verdict == "block") == (i % 5 == 0) for i in range(400)) and got[395].mined_rule and got[395].confidence >= 0.6


def test_tokens_that_are_bad_only_together(spark):
    # host x and path offers are each no worse than the rest, together always bad
    kinds = [("x", "news", 0), ("x", "offers", 1), ("y", "offers", 0), ("y", "news", 1), ("z", "news", 0), ("z", "offers", 0), ("z", "other", 1)]
    rows = [(i, f"http://{h}.org/{d}/{i}", 1 - bad) for i, (h, d, bad) in enumerate(kinds * 40) if not (h, d) == ("z", "other") or i % 2]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame([(r[0], 1 - r[2]) for r in rows], "page_id long, bad int"), url_rules.UrlConfig(lift=1.5)).collect()}
    assert all((got[i] == "block") == (not good) for i, _, good in rows)


def test_random_labels_yield_no_rule(spark):
    from tidespan.llm.scratch import Scratch

    rng = random.Random(2)
    for share in (0.1, 0.5, 0.9):
        rows = [(rng.sample("abcdefghijkl", 5), int(rng.random() < share)) for _ in range(2000)]
        assert url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad int"), url_rules.UrlConfig(), Scratch(spark, "t")).isEmpty()


def test_fixed_rules_teach_what_they_do_not_reach(spark):
    rows = [(i, f"http://s{i}.net/{d}/x") for i, d in enumerate(["es", "fr", "de"] * 40)] + [(500 + i, f"http://t{i}.org/blog/{d}/x") for i, d in enumerate(["es", "de"] * 5)] + [(600 + i, f"http://u{i}.com/news") for i in range(200)] + [(900, "http://z.net/blog/es/" + "long" * 50_000)]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i].verdict == ("allow" if i % 3 == 2 else "block") for i in range(120)) and got[900].verdict == "block" and got[900].rule is None and got[900].mined_rule


@pytest.mark.parametrize("bad_of_ten", [6, 9])
def test_rules_at_high_base_rates(spark, bad_of_ten):
    rows = [(i, f"http://{'bets' if i % 10 < bad_of_ten else 'news'}.org/p/{i}", int(i % 10 >= bad_of_ten)) for i in range(200)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame([(r[0], 1 - r[2]) for r in rows], "page_id long, bad int")).collect()}
    assert all((got[i] == "block") == (not good) for i, _, good in rows)


def test_rules_match_brute_force(spark):
    from itertools import combinations
    from math import exp, log

    from tidespan.llm.scratch import Scratch

    rng = random.Random(3)
    rows = [(tokens := sorted(rng.sample("abcdefg", rng.randint(1, 6))), int(rng.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.2))) for _ in range(300)]
    rows = [([*t, *(x.upper() for x in t if x == "a")], b) for t, b in rows]
    cfg, base, share = url_rules.UrlConfig(support=0.02, least_pages=2, alpha=0.05, confidence=0.5, lift=1.2), sum(b for _, b in rows) / 300, {}
    sets = {c: met for k in range(1, 8) for c in combinations("abcdefg", k) if sum(met := [b for t, b in rows if set(c) <= set(t)]) >= 6}
    for c, met in sets.items():
        s = sum(met) / len(met)
        nats = s * log(s / base) + ((1 - s) * log((1 - s) / (1 - base)) if s < 1 else 0)
        if s >= url_rules.least_confidence(base, cfg) and s > base and exp(-len(met) * nats) * len(sets) <= cfg.alpha:
            share[c] = s
    want = {c for c, x in share.items() if not any(share.get(c[:i] + c[i + 1 :], 0) >= x for i in range(len(c)))}
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad int"), cfg, Scratch(spark, "t")).collect()
    assert {tuple(sorted(i[-1].lower() for i in r["items"])) for r in got} == want and any(len(c) > 1 for c in want)
    assert all(["A", "a"] in r["items"] for r in got if "a" in {x for i in r["items"] for x in i})


# extraction


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"),
        ("<body><nav>Home, a, b</nav><article><h1>T</h1><p>One,  two\n three.<p>Four &lt;five&gt;&nbsp;six, yes.</article><footer>x, y</footer></body>", "T\nOne, two three.\nFour <five> six, yes."),
        ("<div class=sidebar><p>no, no, no</p></div><div id=main><p>yes, this is it</p><div class='comments'><p>spam, spam</p></div></div>", "yes, this is it"),
        ("<main><p>a<br>b, c</p><form>q<input></form><ul><li>x<li>y, z</ul></main>", "a b, c\nx\ny, z"),
        ("<script>if (a<b) '</p>'</script><article><p>text, here</p><!-- <p>no</p> --></article>", "text, here"),
    ],
)
def test_main_text(page, want):
    assert extract.main_text(page) == want


def test_generated_articles_come_back_whole():
    """Known articles of every kind of block amid known boilerplate, the article in a container of its own or beside others."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["river", "stone", "a,", "of", "caf\u00e9", "light,"]) for _ in range(n))
    for _ in range(150):
        made, out = [], []
        for kind in [*rng.choices(["p", "h4", "ul", "table", "dl", "figure", "bare", "pre"], k=rng.randint(2, 9)), "p"]:
            t, u = words(rng.randint(3, 30)), words(4)
            if kind == "bare":
                made.append(f"<hr>{t}<hr>")
                out.append(t)
            elif kind == "figure":
                made.append(f"<figure><img src=x><figcaption>{t}</figcaption></figure>")
                out.append(t)
            elif kind in ("ul", "table", "dl"):
                inner = {"ul": f"<li>{t}<li>{u}", "table": f"<tr><td>{t}</td><td>{u}</td></tr>", "dl": f"<dt>{t}<dd>{u}"}[kind]
                made.append(f"<{kind}>{inner}</{kind}>")
                out += [t, u]
            else:
                made.append(f"<{kind}>{t}</{kind}>")
                out.append(t)
        body = f"<p>{words(60)}, yes</p>" + "".join(made)
        out.insert(0, re.search("<p>(.*?)</p>", body)[1])
        around = rng.choice(["<article>{}</article>", "<div id=content>{}</div>", "<div><div>{}</div></div>"]).format(body)
        junk = "<nav><ul><li><a href=/>Home, sweet, home</a></ul></nav><div class='sidebar'><p>buy, this, now</p></div>"
        page = f"<html><body><header><h1>Site</h1></header>{junk}{around}<div class='comments'><p>first, post</p></div><form><p>mail, me</p></form><footer><p>(c), us</p></footer></body></html>"
        assert extract.main_text(page).split("\n") == out, page


def test_time_is_linear_in_depth():
    from time import perf_counter

    def spent(n):
        at = perf_counter()
        extract.main_text("<div>" * n + "<p>a, b" + "</b></i>" * n + "<ul><li><a>" * (n // 4))
        return perf_counter() - at

    spent(500)
    assert spent(24_000) < 40 * spent(3_000)


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "<p>deep, text</p>"
    pages = spark.createDataFrame([(1, "u", deep, 0), (1, "u", deep, 0), (2, None, "</p></div><b>x, y", 0), (3, "u", None, 0)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract(pages).collect())
    assert got == [(1, "deep, text", 10), (1, "deep, text", 10), (2, "x, y", 4), (3, "", 0)] and extract.extract(pages.limit(0)).isEmpty()


# WARC


def test_warc_round_trip(spark):
    html = {1: "same", 2: "same", 3: None, 4: "", 5: "é\r\n\r\nWARC/1.1\r\nfake", 6: "x" * 200_000, 9: "same"}
    rows = [(i, f"http://h/{i}\r\nX: y" if i == 2 else f"http://h/{i}", h, 1) for i, h in html.items()] + [(6, "http://h/6", html[6], 1)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (html[r.page_id] or "").encode()
        same = max(k for k, v in html.items() if (v or "") == (html[r.page_id] or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == same else ("revisit", same))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_captures_nest_their_records(spark, tmp_path):
    from tidespan.llm.scratch import Scratch

    pages = spark.createDataFrame([(1, "http://h/1", "a"), (2, "http://h/2", "a")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), Scratch(spark, "t"))
    rows = {r.metadata.page_id: r for r in warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert bytes(rows[2].response.payload) == b"a" and rows[1].response.type == "revisit" and rows[1].response.refers_to == rows[2].response.record_id


def test_archives_of_many_members():
    import gzip

    plain = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nX: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body) for i, body in enumerate([b"one", b"", b"\r\n\r\nWARC/1.1\r\n", b"x" * 700_000]))
    cuts = [0, 60, 61, 500, len(plain)]
    members = b"".join(gzip.compress(plain[a:b]) for a, b in zip(cuts, cuts[1:]))
    for data in (plain, gzip.compress(plain), members, members + b"\0" * 9):
        for step in (7, 1 << 18):
            got = [(h["x"], block) for h, block in warc.parse(warc.inflate(data, step))] if len(data) < 99_999 or step > 7 else None
            assert got is None or got == [("0", b"one"), ("1", b""), ("2", b"\r\n\r\nWARC/1.1\r\n"), ("3", b"x" * 700_000)]
    assert list(warc.parse(iter([]))) == []


@pytest.mark.parametrize("bound", [200_000, 0])
def test_record_ids_differ(spark, tmp_path, monkeypatch, bound):
    from tidespan.llm.scratch import Scratch

    monkeypatch.setattr(warc, "BROADCAST_HEADS", bound)
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "u", "a"), (None, "u", ""), (None, "u", None), (0, None, "a")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), Scratch(spark, "t"))
    got = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    ids = [r.response.record_id for r in got]
    assert len(got) == len(rows) == len(set(ids)) and all(r.response.refers_to in ids for r in got if r.response.type == "revisit")
    assert sorted((str(r.metadata.page_id), r.response.type) for r in got) == sorted([("1", "response"), ("1", "response"), ("1", "response"), ("None", "revisit"), ("None", "response"), ("None", "response"), ("0", "revisit")])


# Jaccard join


def brute_components(rows, width, num, den):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    comp = defaultdict(list)
    for i in range(len(rows)):
        comp[find(i)].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in comp[find(i)] if rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


def near_copies(seed, n, base_words, edits):
    """Copies of one text with few or many words changed, so that some link and others do not, and chains exist."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,leaf,num,den,width", [(24, 1000, 9, 10, 3), (3, 1000, 4, 5, 5), (3, 4, 9, 10, 3), (2, 4, 4, 5, 5)])
def test_components_match_brute_force(docs_of, monkeypatch, small, leaf, num, den, width):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard, "LEAF_GROUP", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    texts = [*near_copies(1, 70, 150, [0, 1, 1, 2, 2, 3, 4, 5]), *near_copies(2, 25, 12, [0, 1]), *near_copies(3, 20, 60, [1, 2, 3]), "A b", "a B", "a", "a b c", "one two three four"]
    chained = [" ".join(f"c{j}" for j in range(i, 200 + i)) for i in range(0, 30, 3)]
    rows = [(1000 - i, t) for i, t in enumerate([*texts, *chained])] + [(1, None), (2, ""), (3, " \n"), (4, texts[0]), (4, texts[0]), (None, texts[1]), (None, "nobody else")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(rows), jaccard.JaccardConfig(width, num, den)).collect()), key=str)
    assert got == brute_components(rows, width, num, den)


def test_representatives(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (5, ""), (6, None), (7, "x y z"), (7, "x y z"), (None, "q r s"), (None, "q r s")])
    kept = jaccard.jaccard_representatives(docs)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", "a b c d e f"), ("5", ""), ("6", ""), ("7", "x y z"), ("None", "q r s")] and kept.columns == docs.columns
    assert jaccard.jaccard_representatives(docs.limit(0)).isEmpty()


def test_representatives_with_null_and_repeated_ids(docs_of):
    rng = random.Random(7)
    texts = [*near_copies(5, 40, 60, [0, 1, 2]), *near_copies(6, 30, 30, [0, 0, 1, 9]), *(f"alone {i} a b c d e" for i in range(12)), "", None, "", None]
    rows = [(rng.choice([None, None, rng.randrange(8), 100 + i]), t) for i, t in enumerate(texts)]
    rows += [(None, "only nulls here in this text one two three four five six seven eight nine ten"), (None, "Only nulls here in this text one two three four five six seven eight nine ten"), (None, "zero only nulls here in this text one two three four five six seven eight nine ten")]
    of, least = {}, {}
    for i, n, comp in brute_components([(i, t) for i, (_, t) in enumerate(rows)], 5, 4, 5):
        if n:
            of[rows[i][1]] = comp
            least.setdefault(comp, []).append(rows[i][0])
    kept = jaccard.jaccard_representatives(docs_of(rows)).collect()
    got = sorted((of[r.text], str(r.doc_id)) for r in kept if r.text)
    assert got == sorted((comp, str(min((x for x in ids if x is not None), default=None))) for comp, ids in least.items())
    assert sum(not r.text for r in kept) == 4


def test_cells_of_linked_sets_agree_twice():
    rng = np.random.default_rng(1)
    for num, den in ((9, 10), (4, 5)):
        cfg = jaccard.JaccardConfig(3, num, den)
        for _ in range(200):
            n = int(rng.integers(5, 300))
            a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            b = np.concatenate([a[int(rng.integers(0, max(1, n // 8))) :], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.cell_keys(a, cfg), jaccard.cell_keys(b, cfg))) >= max(jaccard.ring_need(len(a), cfg), jaccard.ring_need(len(b), cfg)) >= 2


def test_regions_of_pivots(spark, docs_of):
    """Two tight clusters and texts between them: every linked pair meets in a region, or is linked to the same pivot; groups of tied documents go."""
    from tidespan.llm.scratch import Scratch

    cfg = jaccard.JaccardConfig(3, 4, 5)
    texts = [*near_copies(11, 60, 100, [0, 2, 4, 9]), *(t.replace("b", "c") for t in near_copies(12, 60, 100, [0, 2, 4, 9]))]
    join = jaccard._Join(docs_of(list(enumerate(texts))), cfg, Scratch(spark, "t"))
    join.hashes = join.sets(join.nodes)
    rows = join.scratch.keep(join.nodes.selectExpr("1L as g", "node", "cast(null as long) as known"), "rows")
    inner, undivided, links = join.voronoi(rows)
    got, sets = defaultdict(set), {r.node: set(r.hashes) for r in join.hashes.collect()}
    for r in inner.collect():
        got[r.node].add((r.g, r.known))
    tied = defaultdict(set)
    for r in links.collect():
        tied[r.b].add(r.a)
        tied[r.a].add(r.a)
        assert len(sets[r.a] & sets[r.b]) * 5 >= 4 * len(sets[r.a] | sets[r.b])
    assert undivided.isEmpty() and 0 < len(got) <= len(sets)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                assert tied[a] & tied[b] or {g for g, _ in got[a]} & {g for g, _ in got[b]}


def test_components_of_chains(spark):
    from tidespan.llm.scratch import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (50, 50)], "a long, b long")
    got = {r.node: r.label for r in jaccard.connected(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tidespan.llm import decontaminate, secret_scan
    from tidespan.llm.scratch import Scratch

    sf, scratch = "/root/testdata/sf0.001", Scratch(spark, "t")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf), name.replace(" ", "-"))
        assert after.columns == cols
        seen.append((docs, after))
        docs = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen[1]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
    assert ids(after) == {d for d, n, c in want if n == 0 or d == c}
    before, after = seen[2]
    bad = decontaminate.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated")
    assert ids(after) == ids(before) - ids(bad)
    before, after = seen[3]
    assert ids(after) == ids(before) and secret_scan.secret_report(after).filter("n_assign + n_access + n_hex > 0").isEmpty()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids(out) == ids(docs) and out.agg(F.sum("taken")).first()[0] > 0
