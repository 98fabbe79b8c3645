"""Deletes, renames and reference rows on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from proofs import PROOFS
from shoplore.operators import cleaning, quality
from shoplore.plans.marketplace import (ADDED_CATEGORIES, CATEGORY_RENAMES, Names, clean, clean_all,
                                        clean_audit)
from shoplore.session import checkpointed
from shoplore.sources.files import add_reference_rows
from shoplore.sources.schemas import SCHEMAS


def values(df, column):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda v: (v is None, v))


def test_delete_keeps_rows_whose_condition_is_unknown(spark):
    df = spark.createDataFrame([("delivered",), ("lost",), (None,)], "status string")
    assert values(cleaning.delete_where(df, F.col("status") != "delivered"), "status") == ["delivered", None]


@pytest.fixture(scope="module")
def child(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")


def parents(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k int")


@pytest.mark.parametrize("salts", [1, 4])
@pytest.mark.parametrize("unique", [True, False])
def test_orphans_by_plain_matching(spark, child, salts, unique):
    kept = cleaning.delete_orphans(child, parents(spark, 2, 3), "k", parent_unique=unique, salts=salts)
    assert kept.columns == ["k", "v"] and values(kept, "v") == ["b", "c", "d"]
    gone = cleaning.orphans(child, parents(spark, 2, 3), "k", parent_unique=unique, salts=salts)
    assert values(gone, "v") == ["a"]
    repeated = cleaning.delete_orphans(child, parents(spark, 2, 2, 2, None), "k", salts=salts)
    assert values(repeated, "v") == ["b", "c", "d"]


@pytest.mark.parametrize("keys", [(2, 3), (2, None), ()])
def test_null_aware_orphans_follow_not_in(spark, child, keys):
    parent = parents(spark, *keys)
    child.createOrReplaceTempView("child")
    parent.createOrReplaceTempView("parent")
    gone = values(spark.sql("select v from child where k not in (select k from parent)"), "v")
    assert values(cleaning.orphans(child, parent, "k", null_aware=True), "v") == gone
    kept = values(cleaning.delete_orphans(child, parent, "k", null_aware=True), "v")
    assert sorted(kept + gone) == ["a", "b", "c", "d"]


def test_orphans_in_a_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    kept = cleaning.delete_orphans(df, parents(spark, 1, 1, 5), "k", salts=8)
    # the hot key's thousand rows, and the rows 1 and 5 under their own keys
    assert kept.count() == 1002


def test_a_chain_of_renames_is_followed_in_order(spark):
    rules = [("a", "b"), ("c", "a"), ("b", "z "), ("never", "x"), ("a", "q")]
    df = spark.createDataFrame([(v,) for v in ["a", "b", "c", "a", "k", None]], "name string")
    assert values(cleaning.rename_values(df, "name", rules), "name") == ["k", "q", "z ", "z ", "z ", None]
    hits = [r["hits"] for r in cleaning.rename_hits(df, "name", rules).orderBy("step").collect()]
    assert hits == [2, 1, 3, 0, 1]


def test_swapping_rules_equal_updates_in_sequence():
    rules = [("a", "b"), ("b", "a"), ("d", "a")]
    final = cleaning.close_renames(rules)
    for start in "abcd":
        value = start
        for old, new in rules:
            value = new if value == old else value
        assert final.get(start, start) == value


def test_category_names_chain_and_keep_the_trailing_space(spark):
    df = spark.createDataFrame([("costruction_tools_tools",), ("telephony",), ("auto",)], "n string")
    assert values(cleaning.rename_values(df, "n", CATEGORY_RENAMES), "n") == [
        "auto", "construction_tools", "telephone "]


def test_reference_rows_are_added_once(spark):
    table = spark.createDataFrame([("a", "A"), ("pc_gamer", "pc_gamer")], "category_name string, en string")
    once = add_reference_rows(table, ADDED_CATEGORIES, "category_name")
    twice = add_reference_rows(once, ADDED_CATEGORIES, "category_name")
    assert once.count() == twice.count() == 4
    missing = cleaning.missing_reference_values(
        spark.createDataFrame([("a",), ("pc_gamer",), (None,), ("b",), ("b",)], "category_name string"),
        once, "category_name")
    assert values(missing, "category_name") == ["b"]


def test_unknown_columns_are_not_dropped_silently(spark):
    with pytest.raises(ValueError, match="no such columns"):
        cleaning.drop_columns(spark.range(1), ["other"])


def marketplace(spark):
    def table(name, rows):
        width = len(SCHEMAS[name].fields)
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], SCHEMAS[name])

    from datetime import datetime as day
    bought, arrived = day(2018, 1, 2, 23, 59), day(2018, 1, 9)
    return {
        "orders": table("orders", [
            ("o1", "c1", "delivered", bought, None, None, arrived), ("o2", "c2", "delivered", bought),
            ("o3", "c3", "canceled", bought, None, None, arrived),
            ("o4", "c4", None, bought, None, None, arrived)]),
        "customer": table("customer", [("c1",), ("c2",), ("c3",), ("c4",)]),
        "order_item": table("order_item", [("o1", None, "p1", "s1"), ("o1", None, "p2", "s1"),
                                           ("o2", None, "p3", "s2"), ("o4", None, "p1", "s3")]),
        "product": table("product", [("p1", "toys"), ("p2",), ("p3", "auto")]),
        "product_category": table("product_category", [("toys", "toys"), ("fone", "telephony")]),
        "seller": table("seller", [("s1",), ("s2",), ("s3",)]),
        "review": table("review", [("r1", "o1", None, None, "bom"), ("r2", "o2"), ("r3", "o4")]),
        "payment": table("payment", [("o1",), ("o1",), ("o3",)]),
    }


def test_cleaning_cascade(spark):
    done = clean_all(marketplace(spark), stage=lambda name, df: checkpointed(df))
    assert values(done["orders"], "order_id") == ["o1", "o4"]
    assert "order_approved_dtm" not in done["orders"].columns
    assert {str(v) for v in values(done["orders"], "order_dt")} == {"2018-01-02"}
    assert values(done["customer"], "cust_id") == ["c1", "c4"]
    assert values(done["order_item"], "product_id") == ["p1", "p1", "p2"]
    assert values(done["product"], "category_name") == ["Not Defined", "toys"]
    assert done["product"].columns == ["product_id", "category_name"]
    assert values(done["seller"], "seller_id") == ["s1", "s3"]
    assert values(done["review"], "review_message") == ["Not Defined", "bom"]
    assert values(done["payment"], "order_id") == ["o1", "o1"]
    assert "telephone " in values(done["product_category"], "category_name_en")
    assert quality.rows_missing(done["product"], "category_name").isEmpty()
    again = clean_all({**done, "orders": done["orders"].drop("order_dt")},
                      Names(unused_order_columns=(), unused_product_columns=()))
    assert {n: d.count() for n, d in again.items()} == {n: d.count() for n, d in done.items()}


def test_audit_adds_up(spark):
    audit = {r["step"]: (r["rows_before"], r["rows_removed"], r["rows_after"])
             for r in clean_audit(marketplace(spark)).collect()}
    assert audit["orders: no delivery time"] == (4, 1, 3)
    assert audit["orders: not delivered"] == (3, 1, 2)
    assert audit["seller: orphans"] == (3, 1, 2)
    assert all(before - removed == after for before, removed, after in audit.values())


def test_null_audits(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert quality.null_counts(df).first().asDict() == {"a": 1, "b": 2}
    empty = spark.createDataFrame([], "a int, b string")
    assert quality.null_flags(empty).first().asDict() == {"is_a_null": False, "is_b_null": False}
    assert quality.null_counts(empty).first().asDict() == {"a": 0, "b": 0}


def test_every_column_is_checked_for_negatives(spark):
    df = spark.createDataFrame([(-1, 2, 3), (-2, None, 4)], "a int, b int, c int")
    rows = {r["measure"]: (r["nulls"], r["negatives"]) for r in quality.numeric_gate(df, "abc").collect()}
    assert rows == {"a": (0, 2), "b": (1, 0), "c": (0, 0)}


def test_orphans_read_each_table_once(spark, tables):
    plan = PROOFS["orphans_removed"].run(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1
    audit = PROOFS["clean_audit"].run(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert {name: audit.count(f"/{name}.parquet") for name in ("customer", "orders")} == {"customer": 2, "orders": 0}


def test_children_without_a_key_do_not_meet_in_one_task(spark, many_partitions):
    child = spark.range(4000).select(F.lit(None).cast("long").alias("k"), "id")
    flagged = cleaning.with_parent_flag(child, spark.createDataFrame([(1,), (None,)], "k long"), "k")
    assert flagged.filter("stays").count() == 4000
    assert cleaning.delete_orphans(child, spark.createDataFrame([], "k long"), "k", null_aware=True).isEmpty()
    assert cleaning.delete_orphans(child, spark.createDataFrame([(None,)], "k long"), "k", null_aware=True).count() == 4000


def test_cleaning_gives_tables_and_audit_together(spark):
    both = clean(marketplace(spark))
    after = {r["step"].split(":")[0]: r["rows_after"] for r in both.audit.collect()}
    assert all(both.tables[name].count() == n for name, n in after.items())


def moved_rows(df):
    """Rows written to shuffles while ``df`` was worked out."""
    df.collect()

    def walk(node):
        kind, metrics = node.getClass().getSimpleName(), node.metrics()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
        kids = node.children()
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rows_of_orders_that_go_do_not_move(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = marketplace(spark)
        many = spark.range(20000).select(F.concat(F.lit("o"), F.col("id")).alias("order_id"))
        tables["payment"] = many.unionByName(many.filter("order_id = 'o1'")).unionByName(
            spark.createDataFrame([(None,)], "order_id string"))
        kept = clean_all(tables)["payment"]
        # o1 twice, o4 and the payment without an order; the bitmap is a handful of rows
        assert moved_rows(kept) < 200
        assert sorted(r["order_id"] or "" for r in kept.collect()) == ["", "o1", "o1", "o4"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["long", "string", "double", "decimal(9,2)"])
def test_the_sieve_flags_as_the_plain_join_does(spark, kind):
    child = spark.createDataFrame([(str(i % 50), i) for i in range(400)] + [(None, 400), ("-1", 401)], "k string, i long")
    child = child.select(F.col("k").cast(kind).alias("k"), "i")
    some = [(str(i),) for i in range(0, 60, 7)] * 2
    for keys, parent_kind, null_aware, salts in ((some, kind, False, 1), (some, "int" if kind == "long" else kind, False, 3),
                                                 ([*some, (None,)], kind, True, 1), ([], kind, True, 3)):
        parent = spark.createDataFrame(keys, "k string").select(F.col("k").cast(parent_kind).alias("k"))
        plain, sieved = (cleaning.with_parent_flag(child, parent, "k", null_aware=null_aware, salts=salts, sieve=s)
                         for s in (False, True))
        assert plain.columns == sieved.columns
        assert sorted(sieved.collect(), key=lambda r: r["i"]) == sorted(plain.collect(), key=lambda r: r["i"])


def test_stored_tables_of_the_cascade_are_read_by_column(spark):
    plan = PROOFS["clean_cascade"].run(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "ExistingRDD[l_orderkey" not in plan and "ExistingRDD[o_orderkey" not in plan
    assert "ReadSchema: struct<l_partkey:bigint,__stays:boolean>" in plan
