"""Audits: missing and negative values, summaries, correlations, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.operators.ordered import exact_quantiles


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of missing values per column, in one pass."""
    return df.agg(*[_count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def null_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of ``is_<column>_null`` flags, in one pass."""
    names = columns or df.columns
    return df.agg(*[
        F.when(_count_if(F.col(c).isNull()) > 0, F.lit(True)).otherwise(F.lit(False))
        .alias(f"is_{c}_null") for c in names])


def rows_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def numeric_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(measure, nulls, negatives)`` for every column, in one pass."""
    row = df.agg(*[
        F.struct(_count_if(F.col(c).isNull()).alias("nulls"),
                 _count_if(F.col(c) < 0).alias("negatives")).alias(c) for c in columns])
    return _long(row, columns, ("nulls", "negatives"))


def _long(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row of structs to one row per column."""
    entries = F.array(*[F.struct(F.lit(c).alias("measure"), *[F.col(c)[f].alias(f) for f in fields])
                        for c in columns])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def describe_numeric(df: DataFrame, columns: Sequence[str],
                     probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, standard deviation (n - 1), minimum, exact quantiles and maximum per column."""
    quantiles = exact_quantiles(df, columns, probabilities)
    names = [f"p{100 * p:g}".replace(".", "_") for p in probabilities]
    row = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            *[F.lit(q).cast("double").alias(n) for n, q in zip(names, quantiles[c])],
            F.max(F.col(c).cast("double")).alias("max"),
        ).alias(c) for c in columns])
    return _long(row, columns, ("count", "mean", "std", "min", *names, "max"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as ``(a, b, r)``, both halves and the diagonal."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"),
                                  F.col(f"r{i}").alias("r")))
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the range of the column as ``(bin, low, high, n)``, empty ones included.

    The last bin is closed, so that the maximum is in it.
    """
    value = F.col(column).cast("double")
    bounds = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if bounds["low"] is None:
        raise ValueError(f"{column} has no values")
    low, width = bounds["low"], (bounds["high"] - bounds["low"]) / bins
    if width == 0:
        raise ValueError(f"{column} is constant")
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (df.filter(value.isNotNull()).groupBy(place.alias("bin"))
              .agg(F.count(F.lit(1)).alias("__n")))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"))
    return (edges.join(counts, "bin", "left")
            .select("bin", "low", "high", F.coalesce("__n", F.lit(0)).cast("long").alias("n")))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency table."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def group_profile(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Mean, minimum and maximum of every measure per group, and the group's size."""
    return df.groupBy(group).agg(
        *[f(F.col(m)).cast("double").alias(f"{m}_{name}") for m in measures
          for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        F.count(F.lit(1)).alias("size"))
