"""Personal data, in DataFrame functions only: expressions propose spans, checksums confirm them, words nearby adjust their scores.

Base kinds are email, ip (parts at most 255), card (14 to 19 digits that pass Luhn) and phone (10 to 15 digits after a plus sign). Their
matches are leftmost, do not overlap within a kind, and always stay; words nearby move their scores only. The method adds four kinds, kept
where the score reaches ``PiiConfig.least`` and no span of a base kind (or of a kind listed before) is in the way:

* iban: country, check digits and account, compact or in groups of four, that pass mod-97;
* pan: a card number of 13 to 19 digits that passes Luhn inside a longer run of numbers, where the base rule sees one number too long;
* ssn: three, two and four digits joined by hyphens, no part all zeros;
* tel: a telephone number without a plus sign. ssn and tel have no checksum, so they need a word nearby that speaks for them.

A score is the prior of the kind, plus ``bonus`` if a word for the kind stands within ``before`` code points before or ``after`` after the
span (the nearest neighbours of the same kind not counted as text), less ``bonus`` if a word against it does (examples, versions, order
numbers), held between 0 and 1.

Positions are code points, the end exclusive. Null or empty texts have no spans. Rows are judged one by one, so repeated rows and ids are
kept; columns of the input stay as they are, except that one named ``pii`` is replaced. Empty tables give empty results. Expressions
are linear in the text: runs are taken whole and never tried again from their middle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "pan", "ssn", "tel")
N_BASE = 4

_LOCAL = "A-Za-z0-9._%+-"
#: The base rules. A match may begin where a run begins or where the match before it ended.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){14})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PAN = r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
TEL = r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9.-])"

#: Words that speak for a kind, in the four languages of the corpora this serves.
FOR = {
    "email": ("mail", "courriel", "correo", "contact", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "client"),
    "card": ("card", "karte", "carte", "tarjeta", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "anruf", "appel", "llama"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "pan": ("card", "karte", "carte", "tarjeta", "visa", "credit", "debit", "payment"),
    "ssn": ("ssn", "social security", "social-security", "tax id"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "anruf", "appel", "llama"),
}
AGAINST = ("example", "sample", "dummy", "version", "isbn", "order no", "invoice no", "part no", "serial")
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "pan": 0.5, "ssn": 0.3, "tel": 0.3}


#: Matches of a document that are placed together; blocks of them are then moved to where they begin, which keeps long lists linear.
BLOCK = 256
_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,value:string,near:string>>)"


@dataclass(frozen=True)
class PiiConfig:
    least: float = 0.5
    bonus: float = 0.25
    before: int = 40
    after: int = 20


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    return f"aggregate(split(reverse({digits}), ''), named_struct('sum', 0, 'odd', true), (a, c) -> named_struct('sum', a.sum + int(if(a.odd, c, translate(c, '0123456789', '0246813579'))), 'odd', not a.odd), a -> a.sum % 10 = 0)"


def mod97(account: str) -> str:
    """SQL: whether an account in upper case, without spaces, passes the ISO 7064 mod 97-10 check."""
    return f"aggregate(split(concat(substring({account}, 5), substring({account}, 1, 4)), ''), 0, (a, c) -> if(c between '0' and '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _places(pattern: str, kind: int, cfg: PiiConfig, passes: str = "true") -> str:
    """SQL for the matches of a pattern that pass: (start, kind, end, value, near), ``near`` the text around without the matches of the kind
    themselves. What lies between matches comes from split, so places are sums of lengths."""
    p = "r'" + pattern + "'"
    pieces, zipped = f"split(text, {p}, -1)", "zip_with(slice(t, 1, size(t) - 1), m, (a, b) -> named_struct('gap', length(a), 'v', b))"
    near = f"lower(concat(right(concat(coalesce(get(t, n - 1), ''), ' ', t[n]), {cfg.before}), ' ', left(concat(t[n + 1], ' ', coalesce(get(t, n + 2), '')), {cfg.after})))"
    step = f"(a, x) -> named_struct('at', a.at + x.gap + length(x.v), 'n', a.n + 1, 'out', if({passes}, concat(a.out, array(named_struct('start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + length(x.v), 'value', x.v, 'near', string(a.n)))), a.out))"
    block = f"aggregate(slice(z, {BLOCK} * b + 1, {BLOCK}), named_struct('at', 0, 'n', {BLOCK} * b, 'out', {_SPANS}), {step})"
    moved = "transform(y.out, s -> named_struct('start', s.start + a.at, 'kind', s.kind, 'end', s.end + a.at, 'value', s.value, 'near', s.near))"
    joined = f"aggregate(transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> {block}), named_struct('at', 0, 'out', {_SPANS}), (a, y) -> named_struct('at', a.at + y.at, 'out', concat(a.out, {moved})), a -> a.out)"
    with_near = f"transform(f, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'value', s.value, 'near', get(transform(array(int(s.near)), n -> {near}), 0)))"
    let = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    return f"if(text rlike {p}, {let(pieces, 't', let(f'regexp_extract_all(text, {p}, 0)', 'm', let(zipped, 'z', let(joined, 'f', with_near))))}, {_SPANS})"


def _rules(cfg: PiiConfig) -> list[str]:
    """SQL for the spans of each kind, in the order of KINDS."""
    d = _digits("x.v")
    bare = "replace(x.v, ' ', '')"
    return [
        _places(EMAIL, 0, cfg),
        _places(IP, 1, cfg, "not exists(split(x.v, '[.]'), p -> double(p) > 255)"),
        _places(CARD, 2, cfg, f"length({d}) between 14 and 19 and {luhn(d)}"),
        _places(PHONE, 3, cfg, f"length({d}) between 10 and 15"),
        _places(IBAN, 4, cfg, f"length({bare}) between 15 and 34 and {mod97(bare)}"),
        _places(PAN, 5, cfg, luhn(d)),
        _places(SSN, 6, cfg, "not x.v rlike '^000|-00-|0000$'"),
        _places(TEL, 7, cfg, f"length({d}) between 9 and 11"),
    ]


def _score(cfg: PiiConfig) -> str:
    """SQL: the score of a span ``x`` from its kind and the words around it."""
    words = lambda ws: "(^|[^a-z])(" + "|".join(ws) + ")"
    prior = "array(" + ",".join(f"{PRIOR[k]}D" for k in KINDS) + ")"
    speaks = "array(" + ",".join("'" + words(FOR[k]) + "'" for k in KINDS) + ")"
    raw = f"get({prior}, x.kind) + if(x.near rlike get({speaks}, x.kind), {cfg.bonus}D, 0D) - if(x.near rlike '{words(AGAINST)}', {cfg.bonus}D, 0D)"
    return f"round(least(1D, greatest(0D, {raw})), 2)"


def scan(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """All columns of ``docs``, then ``pii``: an array of (start, kind, end, value, score), ordered by start, then kind as listed in KINDS."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *[F.expr(sql).alias(f"k{i}") for i, sql in enumerate(_rules(cfg))])
    scored = lambda spans: f"transform({spans}, x -> struct(x.start as start, x.kind as kind, x.end as end, x.value as value, {_score(cfg)} as score))"
    base = "concat(k0, k1, k2, k3)"
    rows = rows.withColumn("spans", F.expr(f"if(size({base}) = 0, cast(array() as array<struct<start:int,kind:int,end:int,value:string,score:double>>), {scored(base)})"))
    for i in range(N_BASE, len(KINDS)):
        free = f"filter(k{i}, x -> not exists(spans, y -> y.start < x.end and x.start < y.end))"
        rows = rows.withColumn("spans", F.expr(f"if(size(k{i}) = 0, spans, concat(spans, filter({scored(free)}, x -> x.score >= {cfg.least}D)))"))
    return rows.select("doc.*", F.expr("array_sort(spans)").alias("pii"))


def _joined(base_only: bool) -> Column:
    kinds = "array(" + ", ".join(f"'{x}'" for x in KINDS) + ")"
    spans = f"filter(pii, x -> x.kind < {N_BASE})" if base_only else "pii"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({kinds}, x.kind), ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and the scores of the spans, in their order."""
    found = scan(docs.select("doc_id", "text"), cfg)
    count = lambda i: F.expr(f"cast(size(filter(pii, x -> x.kind = {i})) as bigint)")
    return found.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(N_BASE)], F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"), F.expr("array_join(transform(pii, x -> format_string('%.2f', x.score)), ',')").alias("scores"))


def redacted(docs: DataFrame, cfg: PiiConfig = PiiConfig(), least: float = 0.0) -> DataFrame:
    """All documents, each span with a score of ``least`` or more replaced by its kind in brackets; spans that overlap share one mark, the first one's."""
    kinds = "array(" + ", ".join(f"'{x}'" for x in KINDS) + ")"
    rows = docs.select(F.struct("*").alias("doc"), "text")
    found = scan(rows, cfg).withColumnRenamed("pii", "spans")
    step = f"(a, x) -> if(x.end <= a.pos, a, named_struct('pos', x.end, 'out', if(x.start >= a.pos, concat(a.out, substring(doc.text, a.pos + 1, x.start - a.pos), '[', get({kinds}, x.kind), ']'), a.out)))"
    text = F.expr(f"if(size(spans) = 0, doc.text, aggregate(filter(spans, x -> x.score >= {least}D), named_struct('pos', 0, 'out', ''), {step}, a -> concat(a.out, substring(doc.text, a.pos + 1))))")
    return found.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
