"""Deleting, filling, renaming and adding rows without changing a table in place.

A DELETE or UPDATE on a stored table becomes a DataFrame that is written once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.functions.columns import is_true
from shoplore.operators.bitmaps import bitmap_of, split_by


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def with_date(df: DataFrame, timestamp: str, out: str) -> DataFrame:
    return df.withColumn(out, F.to_date(timestamp))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Delete the rows for which ``condition`` is true; a row where it is unknown stays."""
    return df.filter(~is_true(condition))


def with_parent_flag(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
                     null_aware: bool = False, parent_unique: bool = False, salts: int = 1,
                     out: str = "stays", sieve: bool = False) -> DataFrame:
    """Add whether a child row stays when orphans go; each table is read once.

    A row stays if its key has a parent or if it has no key. ``null_aware=True`` follows SQL's
    ``NOT IN`` to the letter: one parent row without a key makes every comparison unknown, so every row
    stays, and an empty parent lets none stay. Both are asked of the parent by one aggregate, a
    subquery of the same plan.

    Repeated parent keys are merged before the shuffle. Where the parent key is known to be unique,
    ``parent_unique=True`` skips that, and run-time skew splitting covers a hot child key. Where both
    sides may repeat keys, ``salts`` spreads a hot child key over several tasks. Child rows without a
    key are spread by a hash of the row, so that they do not meet in one task. The hash is of the data,
    not random, so that a task that runs again sends its rows to the same places.

    ``sieve=True`` is for a large child, many of whose rows go, and stored tables: both are read once more, and
    a bitmap of the parent's hashed keys (8 MB at most, broadcast) finds rows that no parent can have. Those, and
    rows without a key, are flagged where they are; only the others move to the join, which is exact. Of more keys
    than the bitmap has places (67 million) it rules out less. Keys other than integers and texts of one
    type on both sides, whose hashes need not follow equality, take the plain way.
    """
    own = F.col(parent_key or key)
    keys = parent.select(own.alias("__key")).filter(F.col("__key").isNotNull())
    sure = None
    if null_aware:
        state = parent.agg(F.when(F.count(F.lit(1)) == 0, "empty").when(F.count_if(own.isNull()) > 0, "unknown")
                           .otherwise("known").alias("state")).scalar()
        sure = F.when(state == "empty", False).when(state == "unknown", True)

    def flagged(rows: DataFrame, stays: Column) -> DataFrame:
        return rows.withColumn(out, stays if sure is None else sure.otherwise(stays))

    kinds = [df.select(column).schema[0].dataType for df, column in ((child, F.col(key)), (keys, F.col("__key")))]
    still = None
    if sieve and kinds[0] == kinds[1] and (isinstance(kinds[0], T.IntegralType) or kinds[0] == T.StringType()):
        hashed = child.withColumn("__hash", F.when(F.col(key).isNotNull(), F.xxhash64(key)))
        child, still = (rows.drop("__hash") for rows in split_by(hashed, "__hash", bitmap_of(keys.select(F.xxhash64("__key")))))
    if not parent_unique:
        keys = keys.distinct()
    met = F.col(key) == F.col("__key")
    if still is None or salts > 1:
        keys = keys.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        row = F.xxhash64(*child.columns)
        salt = F.when(F.col(key).isNull(), F.pmod(row, F.lit(1 << 20)) + salts).otherwise(F.pmod(row, F.lit(salts)))
        child, met = child.withColumn("__salt", salt.cast("int")), met & (F.col("__salt") == F.col("__place"))
    # an unmatched row has no __key
    found = flagged(child.join(keys, met, "left"), F.col(key).isNull() | F.col("__key").isNotNull()).drop("__key", "__place", "__salt")
    return found if still is None else found.unionByName(flagged(still, F.col(key).isNull()))


def delete_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
                   null_aware: bool = False, parent_unique: bool = False, salts: int = 1) -> DataFrame:
    """Delete the child rows whose key has no parent; a child row without a key stays. See
    :func:`with_parent_flag` for the options."""
    flagged = with_parent_flag(child, parent, key, parent_key, null_aware, parent_unique, salts, "__stays")
    return flagged.filter("__stays").drop("__stays")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
            null_aware: bool = False, parent_unique: bool = False, salts: int = 1) -> DataFrame:
    """The rows that :func:`delete_orphans` removes."""
    flagged = with_parent_flag(child, parent, key, parent_key, null_aware, parent_unique, salts, "__stays")
    return flagged.filter("NOT __stays").drop("__stays")


def fill_missing(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.fillna(dict(values))


def close_renames(rules: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Old name to final name for rules that are applied one after another."""
    final: dict[str, str] = {}
    for old, new in rules:
        for start, reached in final.items():
            if reached == old:
                final[start] = new
        # a start that an earlier rule moved away no longer carries this name
        final.setdefault(old, new)
    return final


def rename_values(df: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace values by rules applied in order, as one join with the closed rule list.

    The rules are literals in the program, so their side is small by nature and is broadcast.
    """
    final = list(close_renames(rules).items())
    names = df.sparkSession.createDataFrame(final, "__old string, __new string")
    renamed = df.join(F.broadcast(names), F.col(column) == F.col("__old"), "left")
    return (renamed.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
            .select(*df.columns))


def rename_hits(df: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """How many rows each rule changes, in rule order: ``(step, old, new, hits)``.

    Counted once per distinct value that some rule can touch; a rule also counts the rows that
    earlier rules turned into its old name.
    """
    spark = df.sparkSession
    names = sorted({old for old, _ in rules})
    walked = []
    for start in names:
        value = start
        for step, (old, new) in enumerate(rules, start=1):
            if value == old:
                walked.append((step, start))
                value = new
    steps = spark.createDataFrame([(i, old, new) for i, (old, new) in enumerate(rules, start=1)],
                                  "step int, old string, new string")
    touched = spark.createDataFrame(walked, "step int, __start string")
    counts = (df.join(F.broadcast(touched.select("__start").distinct()),
                      F.col(column) == F.col("__start"), "left_semi")
              .groupBy(F.col(column).alias("__start")).agg(F.count(F.lit(1)).alias("__n")))
    hits = (touched.join(counts, "__start").groupBy("step").agg(F.sum("__n").alias("__hits")))
    return (steps.join(hits, "step", "left")
            .select("step", "old", "new", F.coalesce("__hits", F.lit(0)).cast("long").alias("hits")))


def missing_reference_values(fact: DataFrame, dimension: DataFrame, key: str,
                             dimension_key: str | None = None) -> DataFrame:
    """Distinct values of the fact that the reference table lacks."""
    values = fact.select(key).filter(F.col(key).isNotNull()).distinct()
    known = dimension.select(F.col(dimension_key or key).alias(key))
    return values.join(known, key, "left_anti")
