"""Business reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofs.registry import NET_PRICE_SQL, Tables, net_price, proof, rounded
from shoplore.operators import bitmaps, reports
from shoplore.session import checkpointed
from shoplore.sources.files import read_table

CATEGORIES = ["BRAND#2", "BRAND#9", "BRAND#17"]
# the category table: English names for all brands but some
NAMES_SQL = """names AS (SELECT DISTINCT p_brand, upper(p_brand) AS brand_label FROM part
WHERE p_brand NOT IN ('Brand#1', 'Brand#17'))"""


def _names(t: Tables):
    return (t.part.filter("p_brand not in ('Brand#1', 'Brand#17')")
            .select("p_brand", F.upper("p_brand").alias("brand_label")).distinct())


@proof("""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS INTEGER) AS cust_id,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, o_orderstatus AS status,
       CAST(o_orderdate AS DATE) AS order_dt
FROM orders
""")
def typed_projection(t: Tables):
    declared = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType())])
    orders = read_table(t.spark, f"{t.folder}/orders.parquet", declared)
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("int").alias("cust_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("total"),
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("order_dt"))


def _by_place(t: Tables, places, by, repeated=False):
    """``repeated`` gives orders of one status twice, as a table with repeated order ids would."""
    orders = t.orders.unionByName(t.orders.filter("o_orderstatus = 'F'")) if repeated else t.orders
    return reports.orders_by_place(orders, t.customer, places, by, "o_orderkey", "o_custkey",
                                   "c_custkey", "c_nationkey", "n_nationkey")


REPEATED_SQL = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F')"


@proof(f"""
SELECT n_name, count(DISTINCT o_orderkey) AS orders_cnt
FROM {REPEATED_SQL}, customer, nation
WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey
GROUP BY n_name
""")
def orders_by_nation(t: Tables):
    return _by_place(t, t.nation, ["n_name"], repeated=True)


@proof("""
SELECT r_name, count(DISTINCT o_orderkey) AS orders_cnt
FROM orders, customer, nation, region
WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
GROUP BY r_name
""")
def orders_by_region(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return _by_place(t, places, ["r_name"])


@proof("""
WITH people AS (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1)
SELECT n_name, r_name, population, count(DISTINCT o_orderkey) AS orders_cnt
FROM orders JOIN customer c ON o_custkey = c_custkey
JOIN nation ON c.c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN people ON people.c_nationkey = n_nationkey
GROUP BY 1, 2, 3
""")
def orders_by_nation_population(t: Tables):
    people = (t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"))
              .agg(F.count(F.lit(1)).alias("population")))
    places = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .join(people, "n_nationkey"))
    return _by_place(t, places, ["n_name", "r_name", "population"])


@proof(f"""
WITH goods AS (SELECT p_partkey, p_brand FROM part WHERE p_size <= 40), {NAMES_SQL}
SELECT lineitem.*, goods.p_brand, brand_label
FROM lineitem LEFT JOIN goods ON l_partkey = p_partkey LEFT JOIN names ON goods.p_brand = names.p_brand
""")
def item_enrichment(t: Tables):
    goods = t.part.filter("p_size <= 40").withColumnRenamed("p_partkey", "l_partkey")
    return reports.enrich_items(t.lineitem, goods, _names(t), "l_partkey", "p_brand")


@proof("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders_cnt FROM lineitem GROUP BY 1")
def orders_per_seller(t: Tables):
    return reports.orders_per_seller(t.lineitem, "l_suppkey", "l_orderkey")


@proof("""
SELECT count(DISTINCT l_orderkey) AS orders_cnt, count(DISTINCT l_partkey) AS products_cnt,
       count(DISTINCT l_suppkey) AS sellers_cnt FROM lineitem
""")
def kpi_distincts(t: Tables):
    return reports.distinct_counts(t.lineitem, {
        "orders_cnt": "l_orderkey", "products_cnt": "l_partkey", "sellers_cnt": "l_suppkey"})


def _sales(t: Tables):
    return reports.category_sales(t.lineitem, t.part, _names(t), ["brand_label"], "l_orderkey", "l_partkey",
                                  "p_partkey", "p_brand", "l_extendedprice")


SALES_SQL = f"""
WITH {NAMES_SQL}
SELECT brand_label, count(DISTINCT l_orderkey) AS orders_cnt,
       sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_brand) GROUP BY 1
"""


@proof(f"SELECT brand_label, orders_cnt, CAST(revenue AS DOUBLE) AS revenue FROM ({SALES_SQL})")
def category_popularity_revenue(t: Tables):
    return rounded(reports.largest_first(_sales(t), "revenue", "brand_label"), "revenue", places=2)


@proof(f"""
SELECT brand_label, rank() OVER (ORDER BY orders_cnt DESC) AS pop_ranking,
       rank() OVER (ORDER BY revenue DESC) AS rev_ranks
FROM ({SALES_SQL}) ORDER BY pop_ranking, brand_label LIMIT 10
""")
def category_dual_rank(t: Tables):
    return reports.rank_categories(_sales(t), "brand_label", 10)


@proof("SELECT min(l_extendedprice) AS min_price FROM lineitem")
def min_price(t: Tables):
    return reports.lowest_price(t.lineitem, "l_extendedprice")


@proof("SELECT DISTINCT c_nationkey FROM customer")
def distinct_states(t: Tables):
    return t.customer.select("c_nationkey").distinct()


@proof("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       count(DISTINCT o_orderkey) AS orders_cnt
FROM orders GROUP BY 1, 2, 3
""")
def orders_by_year_month(t: Tables):
    return reports.orders_by_month(t.orders, "o_orderdate", "o_orderkey")


@proof("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS orders_cnt
FROM orders GROUP BY 1
""")
def orders_by_year(t: Tables):
    return reports.orders_by_year(t.orders, "o_orderdate", "o_orderkey")


@proof(f"""
WITH {NAMES_SQL},
wanted AS (SELECT l_suppkey, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_brand)
           WHERE brand_label IN ('BRAND#2', 'BRAND#9', 'BRAND#17')),
sellers AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS num_orders FROM wanted GROUP BY 1
            HAVING count(DISTINCT l_orderkey) > 40)
SELECT count(*) AS sellers_cnt, CAST(sum(num_orders) AS BIGINT) AS orders_summed_over_sellers,
       (SELECT count(DISTINCT l_orderkey) FROM wanted
        WHERE l_suppkey IN (SELECT l_suppkey FROM sellers)) AS distinct_orders
FROM sellers
""")
def orders_in_categories(t: Tables):
    return reports.orders_over_sellers(t.lineitem, t.part, _names(t), CATEGORIES, "l_suppkey", "l_orderkey",
                                       "l_partkey", "p_partkey", "p_brand", "brand_label", more_than=40)


@proof(f"""
WITH {NAMES_SQL}
SELECT l_suppkey, count(DISTINCT p_brand) AS categories_cnt, count(DISTINCT l_partkey) AS products_cnt
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_brand) GROUP BY 1
""")
def seller_specialisation(t: Tables):
    return reports.seller_specialisation(t.lineitem, t.part, _names(t), "l_suppkey", "l_partkey", "p_partkey",
                                         "p_brand", "brand_label")


@proof(f"""
WITH {NAMES_SQL}
SELECT brand_label, count(DISTINCT l_suppkey) AS sellers_cnt
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_brand) GROUP BY 1
""")
def sellers_per_category(t: Tables):
    return reports.sellers_per_category(t.lineitem, t.part, _names(t), "l_suppkey", "l_partkey", "p_partkey",
                                        "p_brand", "brand_label")


@proof("SELECT o_orderstatus, count(DISTINCT o_orderkey) AS orders_cnt FROM orders GROUP BY 1")
def orders_by_status(t: Tables):
    return reports.distinct_counts_by(t.orders, ["o_orderstatus"], {"orders_cnt": "o_orderkey"})


@proof("SELECT l_orderkey, count(DISTINCT l_suppkey) AS num_sellers FROM lineitem GROUP BY 1")
def sellers_per_order(t: Tables):
    return reports.sellers_per_order(t.lineitem, "l_orderkey", "l_suppkey")


@proof(f"""
SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS payment_value FROM
(SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN 0 ELSE {NET_PRICE_SQL} END AS v FROM lineitem)
WHERE v = 0
""")
def zero_payments(t: Tables):
    value = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), F.lit(0).cast("decimal(18,2)"))
    payments = t.lineitem.select("l_orderkey", "l_linenumber",
                                 value.otherwise(net_price()).alias("payment_value"))
    return rounded(reports.zero_payments(payments, "payment_value"), "payment_value")


@proof("""
SELECT count(DISTINCT l_orderkey) AS orders_cnt, count(DISTINCT l_partkey) AS products_cnt,
       count(DISTINCT l_suppkey) AS sellers_cnt FROM lineitem
""")
def kpi_bitmaps(t: Tables):
    return bitmaps.distinct_counts(t.lineitem, {
        "orders_cnt": "l_orderkey", "products_cnt": "l_partkey", "sellers_cnt": "l_suppkey"})


@proof("""
SELECT 'month' AS period, CAST(date_trunc('month', l_shipdate) AS DATE) AS start, count(DISTINCT l_suppkey) AS sellers_cnt
FROM lineitem GROUP BY 2
UNION ALL SELECT 'year', CAST(date_trunc('year', l_shipdate) AS DATE), count(DISTINCT l_suppkey) FROM lineitem GROUP BY 2
UNION ALL SELECT 'all', NULL, count(DISTINCT l_suppkey) FROM lineitem
""")
def sellers_by_period(t: Tables):
    """Months, years and the whole time from one stored table of day bitmaps."""
    days = checkpointed(bitmaps.key_bitmaps(t.lineitem, [F.to_date("l_shipdate").alias("day")], "l_suppkey"))

    def counted(period: str, start):
        return bitmaps.distinct_keys(days, [F.lit(period).alias("period"), start.cast("date").alias("start")], "sellers_cnt")

    return (counted("month", F.trunc("day", "month")).unionByName(counted("year", F.trunc("day", "year")))
            .unionByName(counted("all", F.lit(None))))
