"""Where the queries of this subpackage and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from shoplore.sources.files import read_table


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register ``function(table)`` under its own name; ``table(name)`` reads a given table."""

    def register(function):
        QUERIES[function.__name__] = Query(
            lambda spark, folder: function(lambda name: read_table(spark, f"{folder}/{name}.parquet")), sql)
        return function

    return register
