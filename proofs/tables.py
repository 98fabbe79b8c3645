"""Audits and cleaning. The given tables hold no missing value and no orphan, so both are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofs.registry import Tables, proof, rounded
from shoplore.operators import cleaning, quality
from shoplore.plans.marketplace import Names, clean
from shoplore.session import shared_path
from shoplore.sources.files import add_reference_rows, create_table_as


def _holed_orders(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"))


HOLED_SQL = """(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
                       nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


@proof("""
SELECT lang, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL GROUP BY 1
""")
def rows_missing_value(t: Tables):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return quality.value_counts(quality.rows_missing(joined, "quality"), ["lang"])


@proof(f"""
SELECT o_orderkey, o_orderstatus FROM {HOLED_SQL} WHERE o_orderstatus = 'F' OR o_orderstatus IS NULL
""")
def delete_by_status(t: Tables):
    return (cleaning.delete_where(_holed_orders(t), F.col("o_orderstatus") != "F")
            .select("o_orderkey", "o_orderstatus"))


@proof(f"""
SELECT bool_or(o_orderkey IS NULL) AS is_o_orderkey_null, bool_or(o_custkey IS NULL) AS is_o_custkey_null,
       bool_or(o_orderstatus IS NULL) AS is_o_orderstatus_null,
       bool_or(o_orderpriority IS NULL) AS is_o_orderpriority_null FROM {HOLED_SQL}
""")
def null_flags_orders(t: Tables):
    return quality.null_flags(_holed_orders(t))


@proof(f"""
SELECT count(*) - count(o_orderkey) AS o_orderkey, count(*) - count(o_custkey) AS o_custkey,
       count(*) - count(o_orderstatus) AS o_orderstatus,
       count(*) - count(o_orderpriority) AS o_orderpriority FROM {HOLED_SQL}
""")
def null_counts(t: Tables):
    return quality.null_counts(_holed_orders(t))


SHIFT = 1_000_000_000


def _with_orphans(df, key: str):
    """A table and, under shifted keys that nothing refers to, its rows with an odd key once more."""
    return df.unionByName(df.filter(f"{key} % 2 = 1").withColumn(key, F.col(key) + SHIFT))


def with_orphans_sql(table: str, key: str) -> str:
    return f"""(SELECT * FROM {table} UNION ALL
                SELECT * REPLACE ({key} + {SHIFT} AS {key}) FROM {table} WHERE {key} % 2 = 1)"""


@proof(f"""
SELECT c_custkey, c_name FROM {with_orphans_sql('customer', 'c_custkey')} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def orphans_not_in(t: Tables):
    customers = _with_orphans(t.customer, "c_custkey").select("c_custkey", "c_name")
    return cleaning.orphans(customers, t.orders, "c_custkey", "o_custkey", null_aware=True)


@proof("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def orphans_removed(t: Tables):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return cleaning.delete_orphans(items, t.orders.filter("o_orderstatus = 'F'"), "l_orderkey",
                                   "o_orderkey", parent_unique=True)


@proof("SELECT p_partkey, p_brand, p_retailprice FROM part")
def clean_products(t: Tables):
    return cleaning.drop_columns(t.part, ["p_name", "p_type", "p_size"])


@proof("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_dt FROM orders")
def orders_with_date(t: Tables):
    return cleaning.with_date(t.orders, "o_orderdate", "order_dt").select("o_orderkey", "order_dt")


@proof(f"SELECT o_orderkey, coalesce(o_orderpriority, 'Not Defined') AS o_orderpriority FROM {HOLED_SQL}")
def fill_not_defined(t: Tables):
    return (cleaning.fill_missing(_holed_orders(t), {"o_orderpriority": "Not Defined"})
            .select("o_orderkey", "o_orderpriority"))


RENAMES = [("Brand#3", "Brand#103"), ("Brand#4", "Brand#104"), ("Brand#99", "Brand#199"),
           ("Brand#103", "Brand#203 "), ("Brand#5", "Brand#6")]


@proof("""
SELECT p_partkey, CASE p_brand WHEN 'Brand#3' THEN 'Brand#203 ' WHEN 'Brand#4' THEN 'Brand#104'
                  WHEN 'Brand#5' THEN 'Brand#6' ELSE p_brand END AS p_brand FROM part
""")
def rename_values(t: Tables):
    return cleaning.rename_values(t.part.select("p_partkey", "p_brand"), "p_brand", RENAMES)


@proof("""
SELECT CAST(step AS INTEGER) AS step, old, new, coalesce(n, 0) AS hits FROM
(VALUES (1, 'Brand#3', 'Brand#103', 'Brand#3'), (2, 'Brand#4', 'Brand#104', 'Brand#4'),
        (3, 'Brand#99', 'Brand#199', 'Brand#99'), (4, 'Brand#103', 'Brand#203 ', 'Brand#3'),
        (5, 'Brand#5', 'Brand#6', 'Brand#5')) AS rules(step, old, new, origin)
LEFT JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ON p_brand = origin
""")
def rename_hits(t: Tables):
    return cleaning.rename_hits(t.part, "p_brand", RENAMES)


def _short_dimension(t: Tables):
    return (t.part.filter("p_brand not in ('Brand#7', 'Brand#21')")
            .select("p_brand", F.upper("p_brand").alias("label")).distinct())


@proof("SELECT DISTINCT p_brand FROM part WHERE p_brand IN ('Brand#7', 'Brand#21')")
def missing_reference(t: Tables):
    return cleaning.missing_reference_values(t.part, _short_dimension(t), "p_brand")


@proof("""
SELECT DISTINCT p_brand, CASE WHEN p_brand IN ('Brand#7', 'Brand#21') THEN 'added' ELSE upper(p_brand) END
       AS label FROM part
""")
def reference_rows_added(t: Tables):
    rows = [("Brand#7", "added"), ("Brand#21", "added"), ("Brand#2", "already there")]
    return add_reference_rows(_short_dimension(t), rows, "p_brand")


STAR = Names(
    order="o_orderkey", order_customer="o_custkey", status="o_orderstatus", delivered="F",
    delivery_time="delivered_at", purchase_time="o_orderdate", order_day="order_dt",
    unused_order_columns=("o_totalprice",), customer="c_custkey", item_order="l_orderkey",
    item_product="l_partkey", item_seller="l_suppkey", product="p_partkey", product_category="p_brand",
    unused_product_columns=("p_name", "p_size"), seller="s_suppkey", review_order="l_orderkey",
    review_texts=("l_comment",), payment_order="l_orderkey", category="p_brand", category_label="label",
    added_categories=(("Brand#7", "Added"), ("Not Defined", "Not Defined")),
    category_renames=(("BRAND#2", "TWO"), ("TWO", "TWO "), ("BRAND#5", "FIVE")))


def _star(t: Tables):
    """The tables, whole, in the roles of a marketplace. Orders of one priority count as not delivered yet; rows
    under shifted keys are the customers, products and sellers that fall away."""
    return {
        "orders": t.orders.withColumn("delivered_at", F.when(
            F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate"))),
        "customer": _with_orphans(t.customer, "c_custkey"),
        "order_item": t.lineitem,
        "payment": t.lineitem.select("l_orderkey", "l_extendedprice"),
        "review": t.lineitem.select("l_orderkey", F.nullif("l_linestatus", F.lit("O")).alias("l_comment")),
        "product": _with_orphans(t.part, "p_partkey").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1"))),
        "seller": _with_orphans(t.supplier, "s_suppkey"),
        "product_category": t.part.filter("p_brand <> 'Brand#7'").select(
            "p_brand", F.upper("p_brand").alias("label")).distinct(),
    }


def _stored(name, df):
    """Orders and items are read by several later steps, a few columns at a time."""
    return create_table_as(df, shared_path(df.sparkSession, name)) if name in ("orders", "order_item") else df


STAR_SQL = f"""
WITH timed AS (SELECT * FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
kept AS (SELECT * FROM timed WHERE o_orderstatus = 'F'),
all_cust AS {with_orphans_sql('customer', 'c_custkey')},
all_part AS {with_orphans_sql('part', 'p_partkey')},
all_supp AS {with_orphans_sql('supplier', 's_suppkey')},
cust AS (SELECT * FROM all_cust WHERE c_custkey IN (SELECT o_custkey FROM kept)),
items AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)),
products AS (SELECT * FROM all_part WHERE p_partkey IN (SELECT l_partkey FROM items)),
sellers AS (SELECT * FROM all_supp WHERE s_suppkey IN (SELECT l_suppkey FROM items)),
named AS (SELECT DISTINCT p_brand, upper(p_brand) AS label FROM part WHERE p_brand <> 'Brand#7'
          UNION ALL SELECT * FROM (VALUES ('Brand#7', 'Added'), ('Not Defined', 'Not Defined'))),
labels_now AS (SELECT p_brand, CASE label WHEN 'BRAND#2' THEN 'TWO ' WHEN 'BRAND#5' THEN 'FIVE' ELSE label END AS label FROM named)
"""


@proof(STAR_SQL + """
SELECT 'orders' AS tbl, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum,
       0 AS filled FROM kept
UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT), 0 FROM cust
UNION ALL SELECT 'order_item', count(*), CAST(sum(l_partkey) AS BIGINT), 0 FROM items
UNION ALL SELECT 'payment', count(*), CAST(sum(l_orderkey) AS BIGINT), 0 FROM items
UNION ALL SELECT 'review', count(*), CAST(sum(l_orderkey) AS BIGINT),
                 count(*) FILTER (l_linestatus = 'O') FROM items
UNION ALL SELECT 'product', count(*), CAST(sum(p_partkey) AS BIGINT),
                 count(*) FILTER (p_brand = 'Brand#1') FROM products
UNION ALL SELECT 'seller', count(*), CAST(sum(s_suppkey) AS BIGINT), 0 FROM sellers
UNION ALL SELECT 'product_category', count(*), CAST(sum(length(label) * (ascii(substr(label, 1, 1)))) AS BIGINT),
                 count(*) FILTER (label = 'Not Defined') FROM labels_now
""")
def clean_cascade(t: Tables):
    done = clean(_star(t), STAR, stage=_stored).tables
    letters = F.length("label") * F.ascii(F.substring("label", 1, 1))
    summed = {"orders": "o_orderkey", "customer": "c_custkey", "order_item": "l_partkey",
              "payment": "l_orderkey", "review": "l_orderkey", "product": "p_partkey",
              "seller": "s_suppkey", "product_category": letters}
    filled = {"review": "l_comment", "product": "p_brand", "product_category": "label"}
    rows = None
    for name, column in summed.items():
        holes = (F.count_if(F.col(filled[name]) == "Not Defined") if name in filled
                 else F.lit(0).cast("long"))
        row = done[name].agg(F.count(F.lit(1)).alias("n"), F.sum(column).cast("long").alias("checksum"),
                             holes.alias("filled")).select(F.lit(name).alias("tbl"), "n", "checksum",
                                                           "filled")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@proof(STAR_SQL + """
, counts AS (
SELECT 'orders: no delivery time' AS step, (SELECT count(*) FROM orders) AS rows_before,
       (SELECT count(*) FROM timed) AS rows_after
UNION ALL SELECT 'orders: not delivered', (SELECT count(*) FROM timed), (SELECT count(*) FROM kept)
UNION ALL SELECT 'customer: orphans', (SELECT count(*) FROM all_cust), (SELECT count(*) FROM cust)
UNION ALL SELECT 'order_item: orphans', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM items)
UNION ALL SELECT 'payment: orphans', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM items)
UNION ALL SELECT 'review: orphans', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM items)
UNION ALL SELECT 'product: orphans', (SELECT count(*) FROM all_part), (SELECT count(*) FROM products)
UNION ALL SELECT 'seller: orphans', (SELECT count(*) FROM all_supp), (SELECT count(*) FROM sellers))
SELECT step, rows_before, rows_before - rows_after AS rows_removed, rows_after FROM counts
""")
def clean_audit(t: Tables):
    return clean(_star(t), STAR, stage=_stored).audit


PROOF_DESCRIBE = """
SELECT '{c}' AS measure, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(max({c}), 6) AS max FROM lineitem
"""


@proof(" UNION ALL ".join(PROOF_DESCRIBE.format(c=c)
                          for c in ("l_extendedprice", "l_quantity", "l_discount")))
def describe_numeric(t: Tables):
    summary = quality.describe_numeric(t.lineitem, ["l_extendedprice", "l_quantity", "l_discount"])
    return rounded(summary, "mean", "std", "min", "p25", "p50", "p75", "max")


@proof("""
WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
placed AS (SELECT least(floor((o_totalprice - lo) / w), 19) AS bin FROM orders, b)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high,
       (SELECT count(*) FROM placed WHERE placed.bin = i) AS n
FROM range(20) AS r(i), b
""")
def histogram(t: Tables):
    return rounded(quality.histogram(t.orders, "o_totalprice", 20), "low", "high")


@proof("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_counts(t: Tables):
    return quality.value_counts(t.labels, ["quality", "toxic"])
