"""Reading a table from a database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, partition_column: str | None = None,
                 lower: str | int | None = None, upper: str | int | None = None,
                 partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Options for a JDBC scan. A parallel scan needs the column, both bounds and the count;
    bounds only set the stride, so rows outside them are still read."""
    parallel = (partition_column, lower, upper, partitions)
    if any(part is not None for part in parallel) and any(part is None for part in parallel):
        raise ValueError("a parallel scan needs partition_column, lower, upper and partitions")
    options = {
        "url": url, "dbtable": table, "user": user, "password": password, "driver": driver,
        "partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper,
        "numPartitions": partitions, "fetchsize": fetch_size,
    }
    return {name: str(value) for name, value in options.items() if value is not None}


def read_sql_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Whole database table, in parallel when a partition column and its bounds are given."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
