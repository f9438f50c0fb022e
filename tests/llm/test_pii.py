"""Personal data: base rules against Python's re, checksums, context, and a labelled fixture."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidespan.llm import pii

#: The base rules as the contract states them.
RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if ok(m[0]))


def expected(text: str | None) -> tuple:
    b = base_spans(text)
    sha = hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in b).encode()).hexdigest()
    return (*(sum(x[2] == kind for x in b) for kind in RULES), sha)


def card(prefix: str, n: int) -> str:
    return next(prefix + str(i).zfill(n - len(prefix)) for i in range(20) if luhn(prefix + str(i).zfill(n - len(prefix))))


def check(spark, docs_of, texts):
    rows = pii.report(docs_of(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == expected(texts[r.doc_id]), texts[r.doc_id][:200]
        kept = [s for s in r.spans.split(",") if s]
        assert [s for s in kept if s.split(":")[0] in RULES] == [f"{k}:{s}:{e}" for s, _, k, e in base_spans(texts[r.doc_id])]
        assert len(kept) == len([s for s in r.scores.split(",") if s])
    return {r.doc_id: r.spans for r in rows}


def test_base_rules_against_re(spark, docs_of):
    rng = random.Random(3)
    parts = ["a.b", "@", "mail.example", ".com", "1.2.3.4", "256.1.1.1", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", ".", "é", "😀", "\n", "x", "0", "12345678901234", "+", "()", "%", "@@", "a@b", "a@b.c.", "999999999999999999999999999999.1.1.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    check(spark, docs_of, [None, "", " ", "a@b.c.@d.e", "a@b.c@d.e.f", "😀 1.2.3.4.5.6.7.8 é +49 30 1234567", *texts])


def test_long_runs_are_linear(spark, docs_of):
    """Python's re is quadratic on these, so the spans are stated."""
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 20_000, "+1" * 50_000, "a." * 100_000 + "@", "-" * 100_000, "é" * 50_000 + " x@y.zz " + "é" * 50_000]
    spans = {r.doc_id: r.spans for r in pii.report(docs_of(list(enumerate(texts)))).collect()}
    assert spans.pop(3) == ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(5_000)) and spans.pop(7) == "email:50001:50007"
    assert not any(spans.values())


def test_checksums(spark):
    numbers = ["79927398713", "79927398710", "0", "4111111111111111", "4111111111111112"]
    accounts = ["GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433", "FR1420041010050500013M02606", "NO9386011117947"]
    got = spark.createDataFrame([(x,) for x in numbers], "d string").select("d", F.expr(pii.luhn("d")).alias("ok")).collect()
    assert {r.d: r.ok for r in got} == {x: luhn(x) for x in numbers}
    got = spark.createDataFrame([(x,) for x in accounts], "d string").select("d", F.expr(pii.mod97("d")).alias("ok")).collect()
    assert {r.d for r in got if r.ok} == {a for a in accounts if int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1} and len(accounts) - sum(r.ok for r in got) == 1


def test_context_decides_and_is_scored(spark, docs_of):
    two = f"{card('4', 16)} {card('51', 16)}"
    texts = [
        "my iban is DE89 3704 0044 0532 0130 00 thanks", "code DE89370400440532013001 failed", "ssn 123-45-6789", "part 123-45-6789", "call (030) 555 0199 now", "rows 030 555 0199 in a table",
        f"card {two} twice", "version 1.2.3.4 of it", "server address 10.0.0.1", "ssn 000-45-6789",
    ]
    spans = check(spark, docs_of, texts)
    assert [k.split(":")[0] for k in spans[0].split(",")] == ["iban"] and spans[1] == "" and spans[2] == "ssn:4:15" and spans[3] == "" and spans[4].startswith("tel:5:") and spans[5] == "" and spans[9] == ""
    assert [x.split(":")[0] for x in spans[6].split(",")] == ["pan", "pan"]
    score = {r.doc_id: r.scores for r in pii.report(docs_of([(0, texts[7]), (1, texts[8])])).collect()}
    assert float(score[0]) < float(score[1])


def test_labelled_fixture(spark, docs_of):
    """Recall and false positives by kind; the README quotes these figures."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    fill = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban():
        body = rng.choice(["DE", "FR", "GB"]), digits(18)
        ok = lambda x: int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
        return next(x for x in (f"{body[0]}{c:02d}{body[1]}" for c in range(2, 99)) if ok(x))

    good = {
        "iban": lambda: f"account {iban()}", "ssn": lambda: f"ssn {rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "tel": lambda: f"call {rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4)}", "pan": lambda: f"cards {card(rng.choice('45'), 16)} {card('37', 15)}",
    }
    bad = [lambda: f"id {digits(16)}", lambda: f"hash {digits(9)}-{digits(4)}", lambda: f"isbn 978{digits(10)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"DE{digits(20)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}"]
    rows, truth = [], {}
    for i in range(400):
        kind = rng.choice(sorted(good))
        truth[len(rows)] = kind
        rows.append((len(rows), f"{fill(12)} {good[kind]()} {fill(12)}"))
    for i in range(600):
        truth[len(rows)] = None
        rows.append((len(rows), f"{fill(12)} {rng.choice(bad)()} {fill(12)}"))
    found = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in pii.report(docs_of(rows)).collect()}
    recall = {k: sum(k in found[i] for i, t in truth.items() if t == k) / sum(t == k for t in truth.values()) for k in good}
    wrong = sum(bool(found[i] - set(RULES)) for i, t in truth.items() if t is None) / 600
    assert min(recall.values()) >= 0.95 and wrong <= 0.05, (recall, wrong)


def test_columns_repeats_and_redaction(spark):
    rows = [(1, "x a@b.cc y 1.2.3.4", 5, "d"), (1, "x a@b.cc y 1.2.3.4", 5, "d"), (None, None, 1, None), (3, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k0 int, doc string").withColumn("spans", F.lit("s")).withColumn("pii", F.lit("was")).withColumn("w", F.lit(1))
    got = pii.scan(df)
    assert set(got.columns) == set(df.columns) and got.filter("k0 = 5 and doc = 'd' and spans = 's' and w = 1").count() == 2
    red = pii.redacted(df)
    assert red.columns == df.columns and sorted(map(str, (r.text for r in red.collect()))) == ["", "None", "x [email] y [ip]", "x [email] y [ip]"]
    assert red.filter("pii = 'was'").count() == 4
    assert pii.report(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["executedPlan"])
def test_no_python(spark, docs_of, name):
    plan = str(getattr(pii.report(docs_of([(1, "a@b.cc")]))._jdf.queryExecution(), name)())
    assert not re.search("Python|Arrow|Pandas", plan)
