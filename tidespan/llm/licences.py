"""Licence scans.

An Aho-Corasick automaton finds identifier tags and notice phrases among a text's words, in one pass whatever their number. Where a
tag announces a licence expression, the expression is read from the text and a shunting-yard parser turns it into postfix form
(``with`` binds closest, then ``and``, then ``or``), which is evaluated to its set of licences and to whether it can be met by
permissive licences alone.

The phrases are a parameter: (words, label) pairs. ``BASE`` phrases are always counted; what the method adds is labels.

Null or empty texts have no words, no labels and a score of 0. Malformed expressions give the identifiers that can be read. Rows are
judged one by one, so repeated rows and ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidespan.llm.scratch import slices

#: Phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notice phrases and their labels.
NOTICES = (
    ("apache license", "apache"),
    ("mit license", "mit"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc0", "cc0"),
    ("public domain", "public-domain"),
    ("released into the public domain", "public-domain"),
    ("the unlicense", "unlicense"),
)
#: Tags that announce an expression.
TAGS = ("spdx license identifier", "license expression")
#: First parts of identifiers of permissive licences.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by", "0bsd", "bsl", "public-domain")

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
_LEAD = re.compile(r"[\s:=\"'*/#-]*(?=[^\n\r\"'<>*;,])")
_PART = re.compile(r"[^\n\r\"'<>*;,()A-Za-z0-9.+-]*([()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?)")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t*/#;!-]*(?=[(A-Za-z0-9])")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class LicenceConfig:
    notices: tuple[tuple[str, str], ...] = NOTICES
    tags: tuple[str, ...] = TAGS
    permissive: tuple[str, ...] = PERMISSIVE


@dataclass
class Expression:
    """A licence expression in postfix form."""

    postfix: list[str] = field(default_factory=list)

    @property
    def licences(self) -> list[str]:
        """Identifiers in lower case, without exceptions (what follows ``with``)."""
        stack: list[list[str]] = []
        for x in self.postfix:
            if x in _BINDS and len(stack) >= 2:
                right, left = stack.pop(), stack.pop()
                stack.append(left if x == "with" else left + right)
            elif x not in _BINDS:
                stack.append([x])
        return sorted({y for x in stack for y in x})

    def permissive(self, names: tuple[str, ...]) -> bool:
        """Whether the expression can be met by permissive licences alone: ``or`` needs one side, ``and`` both."""
        stack: list[bool] = []
        for x in self.postfix:
            if x in _BINDS and len(stack) >= 2:
                right, left = stack.pop(), stack.pop()
                stack.append({"or": left or right, "and": left and right, "with": left}[x])
            elif x not in _BINDS:
                stack.append(any(x == n or x.startswith(n + "-") for n in names) and not re.search(r"-n[cd](-|$)", x))
        return bool(stack) and all(stack)


def parse(text: str, at: int = 0) -> Expression:
    """Shunting-yard over the longest well-formed stretch of ``text`` from ``at``: names and operators must alternate. Nothing is read beyond it.

    A line's end, or a character that cannot stand in an expression, ends it; but after an operator and inside brackets it goes on in
    the next line, behind the marks of a comment.
    """
    out: list[str] = []
    hold: list[str] = []
    name_next, depth = True, 0
    while True:
        if (depth or name_next and hold) and (m := _NEXT_LINE.match(text, at)):
            at = m.end()
        if not (m := _PART.match(text, at)):
            break
        part, at = m[1], m.end()
        x = part.lower().rstrip(".") or part
        if x == "(":
            if not name_next:
                break
            hold.append(x)
            depth += 1
        elif x == ")":
            if name_next or not depth:
                break
            depth -= 1
            while (y := hold.pop()) != "(":
                out.append(y)
        elif x in _BINDS:
            if name_next:
                break
            while hold and hold[-1] != "(" and _BINDS[hold[-1]] >= _BINDS[x]:
                out.append(hold.pop())
            hold.append(x)
            name_next = True
            continue
        else:
            if not name_next:
                break
            out.append(x)
            name_next = False
    if name_next and hold and hold[-1] in _BINDS:  # an operator without its right side
        hold.pop()
    out += [x for x in reversed(hold) if x != "("]
    return Expression(out)


class Scanner:
    """Finds phrases among words. Phrases are kept with a space on either side, so a match is a match of whole words."""

    def __init__(self, cfg: LicenceConfig = LicenceConfig()):
        self.cfg, self.automaton = cfg, ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str]]] = {}
        for kind, pairs in (("base", BASE), ("notice", cfg.notices), ("tag", [(t, "") for t in cfg.tags])):
            for phrase, label in pairs:
                found.setdefault(f" {phrase} ", []).append((kind, label))
        for key, value in found.items():
            self.automaton.add_word(key, (len(key), value))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> dict:
        low = (text or "").translate(LOWER) if text and not text.isascii() else (text or "").lower()
        words = WORD.findall(low)
        line = f" {' '.join(words)} "
        places: list[int] = []
        base, labels, expressions = set(), set(), []
        tags: list[int] = []
        for end, (size, kinds) in self.automaton.iter(line):
            start = end - size + 1
            for kind, label in kinds:
                if kind == "base":
                    places.append(start)
                    base.add(label)
                elif kind == "notice":
                    labels.add(label)
                else:
                    tags.append(end)
        # the start of a match in the line is the space before its first word
        first, last = (line.count(" ", 0, p) for p in (min(places), max(places))) if places else (None, None)
        if tags:
            spots = [m.end() for m in WORD.finditer(low)]
            spaces = [i for i, c in enumerate(line) if c == " "]
            for end in tags:
                after = _LEAD.match(text, spots[bisect_left(spaces, end) - 1])
                if after and (e := parse(text, after.end())).postfix:
                    expressions.append(e)
                    labels.update(e.licences)
        labels |= base
        weight = 2 * len(expressions) + len(places) + len(labels)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": weight / (1.0 + weight), "n_expressions": len(expressions), "permissive": all(e.permissive(self.cfg.permissive) for e in expressions) if expressions else None,
        }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, permissive boolean"
_KINDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_expressions", pa.int64()), ("permissive", pa.bool_()))


def scan(docs: DataFrame, cfg: LicenceConfig = LicenceConfig()) -> DataFrame:
    """One row per document: doc_id and what the scanner found in its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(cfg)
        for batch in slices(batches):
            rows = [scanner(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in _KINDS)], names=["doc_id", *(k for k, _ in _KINDS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
