"""Dates, money, labels and three-valued logic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """Exact decimal money, so that a sum does not depend on the order of the tasks."""
    return as_column(value).cast(f"decimal({precision},{scale})")


def days_since(day: str | Column, as_of: str) -> Column:
    """Days from ``day`` to ``as_of``, counting both ends: the same day is 1."""
    return F.datediff(F.lit(as_of).cast("date"), as_column(day)) + F.lit(1)


def is_true(condition: Column) -> Column:
    """A condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def sentiment(score: str | Column, negative_max: int = 2,
              negative: str = "Negative", positive: str = "Positive") -> Column:
    """Review score to sentiment; a missing score stays missing."""
    number = as_column(score).cast("int")
    return (F.when(number <= negative_max, F.lit(negative))
            .when(number.isNotNull(), F.lit(positive)))


def binary_label(label: str | Column, positive: str = "Positive") -> Column:
    """1 for the positive label, 0 for everything else, missing included."""
    return is_true(as_column(label) == F.lit(positive)).cast("int")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """Names like the given ones that no column has yet (Spark compares names without case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
