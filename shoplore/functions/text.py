"""Text cleaning and word splitting.

The character classes are written out (``\\p{L}``, ``\\p{N}``, ``\\p{Nd}``) because the short forms
``\\w`` and ``\\d`` cover ASCII alone in Java.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplore.functions.columns import as_column

# What each cleaning step looks for.
LINE_BREAK = r"[\n\r]"
LINK = r"https?://[!$-_a-z]+"
DAY_FIRST_DATE = r"(?:[0-2][0-9]|3[01])[/.](?:0[0-9]|1[0-2])[/.]\p{Nd}{2,4}"
MONEY = r"R?\$ *\p{Nd}+[,.]\p{Nd}+"
NUMBER = r"[0-9]+"
NOT_A_WORD_CHARACTER = r"[^\p{L}\p{N}_]"
SPACE_RUN = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
TRAILING_SPACE = r"[ \t]+$"
EMOTICON = r":[\)\(]+"
WORD = r"[\p{L}\p{N}_]{2,}"


def blank_line_breaks(text: str | Column, to: str = " ") -> Column:
    return F.regexp_replace(as_column(text), LINE_BREAK, to)


def mask_links(text: str | Column, to: str = " link ") -> Column:
    return F.regexp_replace(as_column(text), LINK, to)


def mask_dates(text: str | Column, to: str = " date ") -> Column:
    return F.regexp_replace(as_column(text), DAY_FIRST_DATE, to)


def mask_money(text: str | Column, to: str = " money ") -> Column:
    return F.regexp_replace(as_column(text), MONEY, to)


def mask_numbers(text: str | Column, to: str = " number ") -> Column:
    return F.regexp_replace(as_column(text), NUMBER, to)


def blank_special_characters(text: str | Column, to: str = " ") -> Column:
    return F.regexp_replace(as_column(text), NOT_A_WORD_CHARACTER, to)


def collapse_spaces(text: str | Column, to: str = " ") -> Column:
    """Runs of white space become ``to``; the end is stripped, a leading space stays."""
    return F.regexp_replace(F.regexp_replace(as_column(text), SPACE_RUN, to), TRAILING_SPACE, "")


def strip_emoticons(text: str | Column) -> Column:
    return F.regexp_replace(as_column(text), EMOTICON, "")


# Order matters: a date must be masked before its digits are.
CLEANING_STEPS = (
    blank_line_breaks,
    mask_links,
    mask_dates,
    mask_money,
    mask_numbers,
    blank_special_characters,
    collapse_spaces,
)


def clean_text(text: str | Column) -> Column:
    """All cleaning steps as one expression over the whole text."""
    return reduce(lambda column, step: step(column), CLEANING_STEPS, as_column(text))


def words(text: str | Column) -> Column:
    """Lower-cased words of two or more characters, in order, as an array."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), F.lit(0))
