"""CSV, tables and JDBC options. No database is started: reading one needs a server or an embedded
engine, so only the options of the scan are checked here."""

from __future__ import annotations

import uuid
from decimal import Decimal

import pytest

from shoplore.operators import rfm
from shoplore.sources import files
from shoplore.sources.jdbc import jdbc_options
from shoplore.sources.schemas import SCHEMAS


def test_csv_with_mark_quotes_and_repeated_names(spark, tmp_path):
    path = tmp_path / "state.csv"
    path.write_bytes("﻿\"state\",\"name\",\"region\",\"people\"\n"
                     "\"SP\",\"São \"\"Paulo\"\"\",\"South, east\",\"44411238.00\"\n".encode())
    row = files.read_csv(spark, str(path), "geolocation_state").first()
    assert tuple(row) == ("SP", 'São "Paulo"', "South, east", Decimal("44411238.00"))
    assert files.read_csv(spark, str(path)).columns == ["state", "name", "region", "people"]
    twice = tmp_path / "count.csv"
    twice.write_text('"extract","extract","count"\n"2016","9","1"')
    assert len(set(files.read_csv(spark, str(twice)).columns)) == 3


def test_csv_round_trip_of_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "line\nbreak"), (3, None)], "i int, t string")
    files.write_splits({"train": df, "test": df.filter("i = 1")}, str(tmp_path / "splits"))
    back = files.read_csv(spark, str(tmp_path / "splits" / "train"), df.schema, multiline=True)
    assert sorted(back.collect()) == sorted(df.collect())
    assert files.read_csv(spark, str(tmp_path / "splits" / "test"), df.schema).count() == 1


def test_create_table_as_keeps_types_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, part string")
    table = files.create_table_as(df, str(tmp_path / "t"), ["part"])
    assert dict(table.dtypes) == dict(df.dtypes)
    plan = table.filter("part = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert files.create_table_as(df.filter("i = 1"), str(tmp_path / "t"), ["part"]).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """No broadcast, so that a join without stored buckets has to shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def stored(df, key, tmp_path, buckets=8):
    name = f"t_{uuid.uuid4().hex}"
    return files.create_bucketed_table(df, name, str(tmp_path / name), [key], buckets)


def test_bucketed_table_keeps_rows_in_one_file_a_bucket(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 90 AS k", "nullif(id % 7, 0) AS v").repartition(6)
    table = stored(df, "k", tmp_path)
    assert dict(table.dtypes) == dict(df.dtypes)
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert len(list(tmp_path.glob("t_*/*.parquet"))) <= 8
    assert table.filter("k = 5").count() == df.filter("k = 5").count()
    empty = stored(df.filter("k < 0"), "k", tmp_path)
    assert empty.count() == 0 and dict(empty.dtypes) == dict(df.dtypes)
    nulls = stored(df.selectExpr("nullif(k, 1) AS k", "v"), "k", tmp_path)
    assert nulls.filter("k IS NULL").count() == df.filter("k = 1").count()


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path, shuffled_joins):
    orders = spark.range(300).selectExpr("id AS order_id", "id % 40 AS cust_id", "date_add(DATE '2018-01-01', CAST(id % 90 AS INT)) AS order_dt")
    items = spark.range(900).selectExpr("id % 310 AS order_id", "CAST(id % 13 AS DECIMAL(12,2)) AS payment_value")
    customers = spark.range(40).selectExpr("id AS cust_id", "'1' AS cust_zip_cd_prefix", "'x' AS cust_city", "'y' AS cust_state")
    by_order, per_order = stored(orders, "order_id", tmp_path), stored(rfm.payments_per_order(items), "order_id", tmp_path)
    lines = stored(items, "order_id", tmp_path)
    assert "Exchange" in plan_of(orders.join(items, "order_id"))
    assert "Exchange" not in plan_of(by_order.join(lines, "order_id").join(per_order.select("order_id"), "order_id"))
    assert "Exchange" not in plan_of(lines.groupBy("order_id").count())
    bills = rfm._per_order(by_order, per_order, rfm.Columns())
    assert "Exchange" not in plan_of(bills) and "SortMergeJoin" in plan_of(bills)
    got = rfm.rfm(by_order, per_order, customers, "2018-08-29")
    # a plain run shuffles orders and payments, and both again; here only what is left of them moves
    assert plan_of(got).count("Exchange hash") < plan_of(rfm.rfm(orders, items, customers, "2018-08-29")).count("Exchange hash")
    assert sorted(got.collect()) == sorted(rfm.rfm(orders, items, customers, "2018-08-29").collect())


def test_declared_schemas(spark, tmp_path):
    assert len(SCHEMAS) == 10
    table = spark.createDataFrame([("o1", Decimal(1), "card", Decimal(2), Decimal("9.99"))], SCHEMAS["payment"])
    table.write.parquet(str(tmp_path / "payment"))
    assert files.read_table(spark, str(tmp_path / "payment"), "payment").first()["payment_value"] == Decimal("9.99")


def test_jdbc_options():
    options = jdbc_options("jdbc:x:y", "orders", user="u", partition_column="id", lower=1, upper=9, partitions=4)
    assert options["numPartitions"] == "4" and options["lowerBound"] == "1" and "password" not in options
    with pytest.raises(ValueError, match="parallel scan"):
        jdbc_options("jdbc:x:y", "orders", partition_column="id")
