"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplore.sources.files import read_table


class Proof(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


PROOFS: dict[str, Proof] = {}


class Tables:
    """The given tables of one folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")


def proof(sql: str | None = None):
    """Register a function of the tables under its own name."""

    def register(function: Callable[[Tables], DataFrame]):
        PROOFS[function.__name__] = Proof(
            lambda spark, folder: function(Tables(spark, folder)), sql)
        return function

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def net_price() -> Column:
    """What a line item costs after its discount, in exact cents."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return (price * (F.lit(1).cast("decimal(4,2)") - discount)).cast("decimal(18,2)")


NET_PRICE_SQL = ("CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
                 " AS DECIMAL(18,2))")
