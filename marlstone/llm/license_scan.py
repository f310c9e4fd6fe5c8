"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a
shunting-yard parser evaluates the and / or / with expressions that follow a tag.

Phrases are matched on whole words of the lower-cased text (ASCII letters, digits and all
characters above ASCII make words). A null text counts as empty, an empty table gives no
rows; repeated rows give equal rows; a text of any length is read whole, in time linear in
it; of the input's columns only the id and the text are read, so no name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Phrase and label.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICE_PHRASES = (
    ("permission is hereby granted free of charge", "mit"),
    ("mit license", "mit"),
    ("apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license", "apache-2.0"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl-2.0"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("cc0", "cc0-1.0"),
    ("creative commons attribution", "cc-by"),
    ("public domain", "public-domain"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("eclipse public license", "epl-2.0"),
    ("proprietary and confidential", "proprietary"),
)
TAG_PHRASE = "spdx license identifier"
#: Identifiers that a training corpus may hold without further terms.
PERMITTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause bsd isc cc0-1.0 unlicense 0bsd zlib cc-by cc-by-4.0 cc-by-3.0 public-domain".split())
_TAG = re.compile(r"spdx[^A-Za-z0-9]{1,3}license[^A-Za-z0-9]{1,3}identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", re.A)
_RANK = {"or": 1, "and": 2, "with": 3}
#: ASCII other than letters and digits separates; capitals become small letters.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def _well_formed(tokens: list[str]) -> int:
    """How many tokens the longest well-formed beginning has."""
    depth = best = 0
    operand = True  # an operand or an opening bracket may come next
    for i, t in enumerate(tokens, 1):
        if (t == "(" or t not in _RANK and t != ")") != operand:
            break
        if t == "(":
            depth += 1
        elif t == ")":
            if not depth:
                break
            depth -= 1
        else:
            operand = t in _RANK
        if not operand and not depth:
            best = i
    return best


def parse_expression(text: str) -> list[str] | None:
    """Postfix form by a shunting yard, of the longest well-formed beginning of the text
    (a tag is often followed by the end of a comment); None if there is none."""
    tokens = [t.rstrip(".:-").lower() if t not in "()" else t for t in _TOKEN.findall(text)]
    out: list[str] = []
    ops: list[str] = []
    for t in tokens[: _well_formed(tokens)]:
        if t == "(":
            ops.append(t)
        elif t == ")":
            while (op := ops.pop()) != "(":
                out.append(op)
        elif t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
        else:
            out.append(t)
    return out + ops[::-1] or None


def identifiers(postfix: list[str]) -> list[str]:
    """Licence identifiers; what follows ``with`` is an exception and not one."""
    names: list[str] = []
    stack: list[tuple[int, int]] = []  # the names of each operand, from and to
    edge = [0] * (len(postfix) + 1)
    for t in postfix:
        if t in _RANK:
            (a, b), (first, _) = stack.pop(), stack.pop()
            if t == "with":
                edge[a] += 1
                edge[b] -= 1
            stack.append((first, b))
        else:
            stack.append((len(names), len(names) + 1))
            names.append(t)
    inside, out = 0, []
    for name, step in zip(names, edge, strict=False):
        inside += step
        if not inside:
            out.append(name)
    return out


def permitted(postfix: list[str], allowed: frozenset[str] = PERMITTED) -> bool:
    """Whether a choice exists under which every licence is allowed."""
    stack: list[bool] = []
    for t in postfix:
        if t in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if t == "with" else (left and right) if t == "and" else (left or right))
        else:
            stack.append(t.removesuffix("+") in allowed)
    return stack[0]


@lru_cache(maxsize=8)
def automaton(phrases: tuple[tuple[str, str, bool], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        known = found.get(f" {phrase} ", ())
        found.add_word(f" {phrase} ", (*known, (label, base, len(phrase) + 1)))
    found.make_automaton()
    return found


PHRASES = (*((p, x, True) for p, x in BASE_PHRASES), *((p, x, False) for p, x in NOTICE_PHRASES), (TAG_PHRASE, "", False))


def scan_text(text: str | None, phrases: tuple[tuple[str, str, bool], ...] = PHRASES) -> dict:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    folded = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    at = word = 0
    tagged = noticed = False
    starts: list[tuple[int, str, bool]] = []
    for end, hits in automaton(phrases).iter(folded):
        starts += [(end - length, label, is_base) for label, is_base, length in hits]
    starts.sort()
    for start, label, is_base in starts:
        word += folded.count(" ", at, start)
        at = start
        if is_base:
            base.append(word)
            base_labels.add(label)
        elif label:
            labels.add(label)
            noticed = True
        else:
            tagged = True
    postfixes = [p for m in _TAG.finditer(text) if (p := parse_expression(m[1]))] if tagged else []
    labels |= {x.removesuffix("+") for p in postfixes for x in identifiers(p)}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | labels)),
        "score": 1.0 if postfixes else 0.9 if noticed else 0.6 if base else 0.0,
        "expressions": "; ".join(" ".join(p) for p in postfixes),
        "permitted": all(permitted(p) for p in postfixes) if postfixes else None,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permitted boolean"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple[tuple[str, str, bool], ...] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: the key, counts and places of base phrases, all labels,
    the postfix expressions of tags, and whether they are permitted."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"score": pa.float64(), "permitted": pa.bool_()} | dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64())
        for b in batches:
            rows = [scan_text(t.as_py(), phrases) for t in b.column(1)]
            names = list(scan_text(""))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names)], [key, *names])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, {SCHEMA}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
