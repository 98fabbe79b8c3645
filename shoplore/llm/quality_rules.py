"""Line-first cleaning: judge every line, drop the lines that fail, reject documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fresh, per_text, words_of

# Characters and phrases that the rules look for.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›·•"
BLANKS = " \t\n\x0b\x0c\r"
LINE_END = ".!?…:;,\"'”’»)]"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "general public license",
    "creative commons", "copyright ©", "privacy policy", "terms of use", "terms of service",
    "cookie policy", "use of cookies", "accept cookies", "enable javascript", "sign up for", "log in to",
    "subscribe to our", "click here to", "share this", "read more", "skip to content")


@dataclass(frozen=True)
class LineRules:
    """Limits are per hundred words of the line; a line that breaks any of them goes.

    symbols: characters of ``#*$%&|<>``. shouts: runs of two or more ``!`` or ``?``.
    separators: navigation separators, at least three of them. short: a line of at most so many
    words has to end like a sentence. boilerplate: a line of at most so many words with one of the
    phrases. lost: a document goes when more than so many per cent of its words are in lines that go.
    """

    symbols: int = 30
    shouts: int = 20
    separators: int = 20
    short: int = 4
    boilerplate: int = 25
    lost: int = 70
    window: int = 5
    least_words: int = 10
    most_repeated: int = 20


def line_fails(line: str, n_words: int, rules: LineRules) -> bool:
    """True if a line with at least one word breaks a rule."""
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols * n_words:
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 100 * separators > rules.separators * n_words:
        return True
    if ("!" in line or "?" in line) and 100 * len(_SHOUT.findall(line)) > rules.shouts * n_words:
        return True
    if n_words <= rules.short and line.rstrip(BLANKS)[-1:] not in LINE_END:
        return True
    if n_words <= rules.boilerplate:
        low = line.lower()
        return any(phrase in low for phrase in BOILERPLATE)
    return False


_SHOUT = re.compile("[!?]{2,}")


def repeated_words(words: Sequence[bytes], width: int) -> int:
    """Words in windows of ``width`` words that occur twice or more, the first time included.

    Windows are compared exactly: words become numbers, and pairs of numbers become numbers again,
    so memory is a few integers a word however long the text is.
    """
    import numpy as np
    import pandas as pd

    n = len(words) - width + 1
    if n < 2:
        return 0
    block, size = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64), 1

    def paired(step: int):
        left, right = block[:-step], block[step:]
        return left * (int(block.max()) + 1) + right

    while size * 2 <= width:
        block, size = np.unique(paired(size), return_inverse=True)[1], size * 2
    if size < width:
        block = paired(width - size)
    _, inverse, counts = np.unique(block, return_inverse=True, return_counts=True)
    begun = np.concatenate([[0], np.cumsum(counts[inverse] > 1)])
    place = np.arange(len(words))
    return int((begun[np.minimum(place + 1, n)] > begun[np.maximum(place - width + 1, 0)]).sum())


_FIELDS = [T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "n_lost_lines")]


def _measures(text: str | None, rules: LineRules, want_text: bool) -> tuple:
    if text is None:
        return 0, 0, 0, 0, 0, 0, 0, None
    words = words_of(text)
    seen, dup, lost_words, lost_lines, stay = set(), 0, 0, 0, []
    for line in text.split("\n"):
        n = len(words_of(line))
        if n:
            dup += line in seen
            seen.add(line)
            if line_fails(line, n, rules):
                lost_words += n
                lost_lines += 1
                continue
        stay.append(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup,
            repeated_words(words, rules.window), lost_words, lost_lines,
            "\n".join(stay) if want_text else None)


def line_measures(df: DataFrame, key: str, text: str, rules: LineRules = LineRules(),
                  cleaned: str | None = None) -> DataFrame:
    """``key``, the counts of a text and, under the name ``cleaned``, the text without failed lines.

    One pass without a shuffle. A null text has no words, and its cleaned text is null.
    """
    fields = [*_FIELDS, *([T.StructField(cleaned, T.StringType())] if cleaned else [])]

    def make():
        def work(texts):
            rows = [_measures(t, rules, bool(cleaned)) for t in texts]
            return [list(c) for c in zip(*rows)][:len(fields)]

        return work

    return per_text(df, key, text, fields, make)


def base_failed(rules: LineRules = LineRules()) -> Column:
    return ((F.col("n_words") < rules.least_words)
            | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))


def lost_too_much(rules: LineRules = LineRules()) -> Column:
    return 100 * F.col("n_lost_words") > rules.lost * F.col("n_words")


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text",
                  rules: LineRules = LineRules()) -> DataFrame:
    """A verdict for each row: its counts, ``base_failed`` and ``kept``.

    Rows are judged by themselves, in any number: repeated rows and repeated keys give a row each, a
    null key stays null, a null or empty text has no words and fails. Other columns are not read.
    """
    failed = base_failed(rules)
    return line_measures(df.select(key, text), key, text, rules).select(
        "*", failed.alias("base_failed"), (~failed & ~lost_too_much(rules)).alias("kept"))


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules(),
                n_chars: str | None = "n_chars") -> DataFrame:
    """The rows that are kept, with all their columns, their text without the lines that failed.

    ``n_chars``, where such a column exists, is counted again. Rows carry their own verdict, so no
    join is needed and repeated rows stay repeated. An empty table gives an empty table.
    """
    (row,) = fresh(df.columns, "row")
    (cleaned,) = fresh([f.name for f in _FIELDS], "cleaned")
    # the row travels as the key of the pass
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), F.col(f"`{text}`").alias("text"))
    judged = line_measures(whole, row, "text", rules, cleaned).filter(~base_failed(rules) & ~lost_too_much(rules))
    out = []
    for c in df.columns:
        if c == text:
            out.append(F.col(cleaned).alias(c))
        elif n_chars and c == n_chars:
            out.append(F.char_length(F.col(cleaned)).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(row)[c].alias(c))
    return judged.select(*out)
