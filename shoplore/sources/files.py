"""Parquet and CSV in and out, and rows added to small reference tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.sources.schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; ``schema`` may be a declared table name, a struct, or nothing."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(SCHEMAS[schema] if isinstance(schema, str) else schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multiline: bool = False) -> DataFrame:
    """CSV with a header line. A byte-order mark is skipped; a quote inside a field is doubled.

    With a schema, columns go by position, so the header may use other names. Without one, all
    columns are text and repeated header names are numbered. ``multiline`` reads quoted line breaks
    but makes a file unsplittable, so it is off unless the texts need it.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        reader = (reader.option("enforceSchema", True)
                  .schema(SCHEMAS[schema] if isinstance(schema, str) else schema))
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files, one per partition, each with a header."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(parts: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One CSV folder per named split."""
    for name, df in parts.items():
        write_csv(df, f"{folder}/{name}", mode)


def create_table_as(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                    mode: str = "overwrite") -> DataFrame:
    """Write the result of a query once and read it back as a table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_bucketed_table(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int,
                          sort_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as table ``name`` at ``path``, its rows dealt into ``buckets`` by a hash of ``keys``, and read it back.

    Tables with equal buckets meet on their keys, and are grouped by them, without a shuffle. Rows
    are dealt before they are written, so there is one file per bucket (none for an empty one) and not one per task and
    bucket. Rows of one key share a bucket: a table in which one key holds much of the rows is added up per key first
    or stored plain. Choose ``buckets`` for the size the table will grow to, some hundred MB each. A table that
    has this name already is an error.
    """
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
     .sortBy(*(sort_by or keys)).option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def add_reference_rows(table: DataFrame, rows: Sequence[tuple], key: str) -> DataFrame:
    """Append literal rows whose key the table lacks, so that running it twice adds nothing.

    The rows are literals in the program, so that side is small by nature and is broadcast; the
    table itself is read to find which of those keys it already holds and is not shuffled.
    """
    spark = table.sparkSession
    added = spark.createDataFrame(list(rows), table.schema)
    present = (table.join(F.broadcast(added.select(key)), key, "left_semi")
               .select(key).distinct())
    return table.unionByName(added.join(present, key, "left_anti"))
