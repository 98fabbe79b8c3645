"""Licence notices and identifier tags in texts.

One Aho-Corasick automaton over the words of a text finds notice phrases and the tags that announce a
licence expression. What follows a tag is parsed by the shunting-yard method and evaluated: ``AND``
binds by all of its licences, ``OR`` leaves the choice and so takes the freer side, ``WITH`` an exception
for linking loosens a copyleft licence.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import per_text

# Phrases as the words of public licence texts, identifiers as the public SPDX list has them.
#: Phrases whose places are counted.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further phrases that name a licence.
NOTICES = (
    ("all rights reserved", "all-rights-reserved"),
    ("cc by 4 0", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc0 1 0", "cc0"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("eclipse public license", "epl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of the tags before a licence expression.
TAGS = ("spdx license identifier", "license expression")
#: Identifiers of expressions, in lower case and without ``-only``, ``-or-later`` and ``+``.
IDENTIFIERS = {
    "0bsd": "0bsd", "agpl-3.0": "agpl", "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "cc-by-4.0": "cc-by", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nd-4.0": "cc-by-nd", "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0", "epl-2.0": "epl", "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3", "isc": "isc", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mit": "mit", "mpl-2.0": "mpl",
    "unlicense": "unlicense", "zlib": "zlib",
}
#: Exceptions that let other code link to a work.
LINKING = ("autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "gcc-exception-3.1",
           "llvm-exception", "openjdk-assembly-exception-1.0")
#: How far a licence limits use, from 0 (not at all) to 1.
LIMITS = {
    "0bsd": 0.0, "cc0": 0.0, "unlicense": 0.0,
    "apache-2": 0.1, "bsd": 0.1, "cc-by": 0.1, "isc": 0.1, "mit": 0.1, "zlib": 0.1,
    "epl": 0.4, "lgpl": 0.4, "mpl": 0.4,
    "cc-by-sa": 0.5, "other": 0.5,
    "gpl-2": 0.6, "gpl-3": 0.6, "agpl": 0.7,
    "cc-by-nc": 0.8, "cc-by-nd": 0.8, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.9,
    "all-rights-reserved": 1.0,
}
LINKED_LIMIT = 0.4

_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OPENS = re.compile(r"[ \t\"']*[:=][ \t\"']*")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def word_list(text: str | None) -> list[bytes]:
    """Runs of digits, letters and whatever is not ASCII, A-Z in lower case, as UTF-8."""
    return [] if not text else text.encode("utf-8", "replace").translate(_BYTES).split()


@dataclass(frozen=True)
class Terms:
    """What a part of an expression comes to: its limit, the licences to go by, and all that it names."""

    limit: float
    chosen: frozenset[str]
    named: frozenset[str]


def _licence(identifier: str) -> Terms:
    name = re.sub(r"(\+|-only|-or-later)$", "", identifier.lower())
    label = IDENTIFIERS.get(name, "other")
    return Terms(LIMITS[label], frozenset([label]), frozenset([label]))


def _apply(operator: str, left: Terms, right: Terms | str) -> Terms:
    if operator == "with":
        loosened = left.limit in (LIMITS["gpl-2"], LIMITS["agpl"]) and right.lower() in LINKING
        return Terms(LINKED_LIMIT, left.chosen, left.named) if loosened else left
    named = left.named | right.named
    if operator == "or":
        freer = right if right.limit < left.limit else left
        return Terms(freer.limit, freer.chosen, named)
    return Terms(max(left.limit, right.limit), left.chosen | right.chosen, named)


def evaluate(source: str, begin: int = 0) -> tuple[str, Terms] | None:
    """The licence expression that begins at ``begin`` and what it comes to; None if there is none.

    It ends with the line, at a character that no expression has, at an identifier without an operator
    before it, or at a closing bracket never opened. Brackets left open are closed and an operator without
    a right side is dropped. ``WITH`` binds before ``AND``, ``AND`` before ``OR``; case does not matter.
    """
    values: list = []
    waiting: list[str] = []
    read: list[str] = []
    wants_operand, opened = True, 0

    def reduce_while(least: int) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= least:
            right, left = values.pop(), values.pop()
            values.append(_apply(waiting.pop(), left, right))

    at = begin
    while found := _TOKEN.match(source, at):
        token, at = found.group(1), found.end()
        kind = token.lower()
        if kind in _BINDS:
            if wants_operand:
                break
            reduce_while(_BINDS[kind])
            waiting.append(kind)
            wants_operand = True
        elif kind == "(":
            if not wants_operand or waiting and waiting[-1] == "with":
                break
            waiting.append("(")
            opened += 1
        elif kind == ")":
            if wants_operand or not opened:
                break
            reduce_while(1)
            waiting.pop()
            opened -= 1
        else:
            if not wants_operand:
                break
            values.append(token if waiting and waiting[-1] == "with" else _licence(token))
            wants_operand = False
        read.append(token)
    while read and (read[-1] == "(" or read[-1].lower() in _BINDS):  # nothing came after these
        read.pop()
        waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        else:
            reduce_while(1)
    return (" ".join(read), values[-1]) if values else None


def _automaton(phrases: Sequence[tuple[str, str]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for kind, (phrase, label) in enumerate(phrases):
        kinds.setdefault(f" {phrase} ", []).append((kind, len(phrase.split()), label))
    for phrase, uses in kinds.items():
        found.add_word(phrase, uses)
    found.make_automaton()
    return found


def find_licences(text: str | None, automaton, phrases: Sequence[tuple[str, str]]) -> tuple[int, list, list]:
    """Number of words, phrases ``(place, kind)`` in the order they end, tags ``(place, expression, terms)``."""
    words = word_list(text)
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places, tags, at, passed = [], [], 0, 0
    for end, uses in automaton.iter(line):
        passed += line.count(" ", at, end)  # words that end before this blank
        at = end
        for kind, size, label in uses:
            (places if label else tags).append((passed - size, kind))
    if not tags:
        return len(words), places, []
    ends = {place + len(phrases[kind][0].split()) - 1 for place, kind in tags}
    after = {}
    for number, match in enumerate(_WORD.finditer(text)):
        if number in ends:
            after[number] = match.end()
    told = []
    for place, kind in tags:
        opened = _OPENS.match(text, after[place + len(phrases[kind][0].split()) - 1])
        if opened and (found := evaluate(text, opened.end())):
            told.append((place, *found))
    return len(words), places, told


_PLACE = T.StructType([T.StructField("place", T.LongType()), T.StructField("label", T.StringType()),
                       T.StructField("phrase", T.StringType())])
_TAG = T.StructType([T.StructField("place", T.LongType()), T.StructField("expression", T.StringType()),
                     T.StructField("chosen", T.ArrayType(T.StringType())), T.StructField("named", T.ArrayType(T.StringType())),
                     T.StructField("limit", T.DoubleType())])


def scan_licences(df: DataFrame, key: str = "doc_id", text: str = "text",
                  phrases: Sequence[tuple[str, str]] = BASE_PHRASES + NOTICES, tags: Sequence[str] = TAGS) -> DataFrame:
    """``key``, ``n_words``, ``phrases`` (array of place, label, phrase), ``tags`` (array of place,
    expression, licences chosen and named, limit), ``labels`` (sorted, distinct: of the phrases, and the licences
    chosen in the expressions) and ``score``, the limit of the strictest of them, 0 without any.

    Words are runs of digits, letters and whatever is not ASCII; places count them from 0 and stand in
    ascending order. A phrase is found wherever its words stand consecutively, overlaps included. Whole texts
    are read, one row per row, without a shuffle; null and empty texts have no words. Only the key and the
    text are read. Repeated rows and null keys give a row each.
    """
    patterns = [*phrases, *[(t, "") for t in tags]]

    def make():
        automaton = _automaton(patterns)

        def work(texts):
            out = []
            for text in texts:
                n, places, told = find_licences(text, automaton, patterns)
                found = [{"place": p, "label": patterns[k][1], "phrase": patterns[k][0]} for p, k in sorted(places)]
                labels = {f["label"] for f in found}.union(*[t.chosen for _, _, t in told])
                score = max([LIMITS.get(f["label"], LIMITS["other"]) for f in found] + [t.limit for _, _, t in told], default=0.0)
                out.append((n, found, [{"place": p, "expression": e, "chosen": sorted(t.chosen), "named": sorted(t.named),
                                        "limit": t.limit} for p, e, t in told], sorted(labels), score))
            return list(zip(*out)) if out else [[] for _ in range(5)]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(_PLACE)),
              T.StructField("tags", T.ArrayType(_TAG)), T.StructField("labels", T.ArrayType(T.StringType())),
              T.StructField("score", T.DoubleType())]
    return per_text(df, key, text, fields, make)


def licence_digest(scanned: DataFrame, key: str = "doc_id", base: Sequence[tuple[str, str]] = BASE_PHRASES) -> DataFrame:
    """One flat row per scanned row: ``n_base`` places of the ``base`` phrases, the first and the last of
    them (null without any), their labels, all labels, and the score."""
    known = F.filter("phrases", lambda p: p["phrase"].isin([phrase for phrase, _ in base]))
    counted = scanned.withColumn("__base", known)
    return counted.select(
        key, "n_words", F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.col("__base.place")).alias("first_word"), F.array_max(F.col("__base.place")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("__base.label"))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
