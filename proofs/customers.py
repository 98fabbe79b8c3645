"""Recency, frequency and monetary profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofs.registry import NET_PRICE_SQL, Tables, net_price, proof, rounded
from shoplore.operators import quality, rfm as profiles
from shoplore.session import checkpointed, shared_path
from shoplore.sources.files import create_bucketed_table, create_table_as

AS_OF = "2001-08-01"
MEASURES = ["recency", "frequency", "monetary"]

STAR = profiles.Columns(
    customer="o_custkey", order="o_orderkey", day="o_orderdate", payment_order="l_orderkey",
    payment_value="payment_value", customer_key="c_custkey",
    attributes=("c_name", "c_nationkey", "c_mktsegment"))


def payments(t: Tables):
    return t.lineitem.select("l_orderkey", net_price().alias("payment_value"))


def profile(t: Tables, orders=None):
    """The profile of every paying customer; money as double from here on."""
    built = profiles.rfm(t.orders if orders is None else orders, payments(t), t.customer, AS_OF, STAR,
                         drop_nonpositive=True)
    return built.withColumn("monetary", F.col("monetary").cast("double"))


def measures(t: Tables):
    """Key and measures alone, stored because several passes read them."""
    return checkpointed(profile(t).select("o_custkey", *MEASURES))


RFM_SQL = f"""
paid AS (SELECT l_orderkey AS k, {NET_PRICE_SQL} AS v FROM lineitem),
visits AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS frequency,
           CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}') + 1 AS INTEGER) AS recency
           FROM orders GROUP BY 1),
spent AS (SELECT o_custkey, CAST(sum(v) AS DOUBLE) AS monetary FROM orders JOIN paid ON k = o_orderkey
          GROUP BY 1 HAVING sum(v) > 0),
rfm AS (SELECT visits.o_custkey, c_name, c_nationkey, c_mktsegment, frequency, recency, monetary
        FROM visits JOIN spent ON visits.o_custkey = spent.o_custkey
        JOIN customer ON c_custkey = visits.o_custkey)
"""


@proof("SELECT o_custkey, count(DISTINCT o_orderkey) AS frequency FROM orders GROUP BY 1")
def frequency(t: Tables):
    return profiles.frequency(t.orders, STAR)


@proof(f"""
SELECT o_custkey, CAST(DATE '{AS_OF}' - CAST(max(o_orderdate) AS DATE) + 1 AS INTEGER) AS recency
FROM orders GROUP BY 1
""")
def recency_latest(t: Tables):
    return profiles.recency(t.orders, AS_OF, STAR)


@proof(f"""
SELECT o_custkey, CAST(DATE '{AS_OF}' - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS recency
FROM orders GROUP BY 1, 2
""")
def recency_per_date(t: Tables):
    return profiles.recency(t.orders, AS_OF, STAR, mode="per_date")


@proof(f"""
SELECT o_custkey, CAST(sum({NET_PRICE_SQL}) AS DOUBLE) AS monetary
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def monetary(t: Tables):
    return rounded(profiles.monetary(t.orders, payments(t), STAR), "monetary")


@proof(f"WITH {RFM_SQL} SELECT * FROM rfm")
def rfm_table(t: Tables):
    """Written once as a table and read back, as later analyses do."""
    return create_table_as(profile(t), shared_path(t.spark, "rfm"))


def by_order(df, key: str, name: str, buckets: int = 32):
    """A stored table of the session's catalog whose rows are dealt into buckets by their order."""
    return create_bucketed_table(df, f"{name}_{uuid.uuid4().hex}", shared_path(df.sparkSession, name), [key], buckets)


@proof(f"WITH {RFM_SQL} SELECT * FROM rfm")
def rfm_bucketed(t: Tables):
    """From orders and payments stored by order, which meet without a shuffle."""
    orders = by_order(t.orders, "o_orderkey", "orders")
    paid = by_order(profiles.payments_per_order(payments(t), STAR), "l_orderkey", "payments")
    built = profiles.rfm(orders, paid, t.customer, AS_OF, STAR, drop_nonpositive=True)
    return built.withColumn("monetary", F.col("monetary").cast("double"))


@proof(f"""
WITH {RFM_SQL}
SELECT rfm.o_custkey, frequency, per_date.recency, monetary
FROM rfm JOIN (SELECT DISTINCT o_custkey,
               CAST(DATE '{AS_OF}' - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS recency FROM orders) per_date
ON per_date.o_custkey = rfm.o_custkey
""")
def rfm_table_per_date(t: Tables):
    built = profiles.rfm(t.orders, payments(t), t.customer, AS_OF, STAR, mode="per_date",
                         drop_nonpositive=True)
    return rounded(built.select("o_custkey", "frequency", "recency", "monetary"), "monetary")


CATEGORIES = ["Brand#2", "Brand#9", "Brand#17"]
_WANTED_SQL = """(SELECT * FROM {orders} WHERE o_orderkey IN
(SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
 WHERE p_brand IN ('Brand#2', 'Brand#9', 'Brand#17')))"""


@proof(f"""
WITH chosen AS {_WANTED_SQL.format(orders='orders')},
{RFM_SQL.replace('FROM orders', 'FROM chosen')} SELECT * FROM rfm
""")
def rfm_in_categories(t: Tables):
    chosen = profiles.orders_in_categories(
        t.orders, t.lineitem, t.part, CATEGORIES, "o_orderkey", "l_orderkey", "l_partkey", "p_partkey",
        "p_brand")
    return profile(t, chosen)


@proof(f"""
WITH {RFM_SQL}, wide AS (SELECT rfm.*, c_acctbal FROM rfm JOIN customer ON c_custkey = o_custkey)
SELECT 'recency' AS measure, count(*) FILTER (recency IS NULL) AS nulls,
       count(*) FILTER (recency < 0) AS negatives FROM wide
UNION ALL SELECT 'frequency', count(*) FILTER (frequency IS NULL), count(*) FILTER (frequency < 0) FROM wide
UNION ALL SELECT 'monetary', count(*) FILTER (monetary IS NULL), count(*) FILTER (monetary < 0) FROM wide
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL), count(*) FILTER (c_acctbal < 0) FROM wide
""")
def numeric_gate(t: Tables):
    balances = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return quality.numeric_gate(profile(t).join(balances, "o_custkey"), [*MEASURES, "c_acctbal"])


@proof(f"""
WITH {RFM_SQL}, pairs(a, b, r) AS (
SELECT 'recency', 'frequency', corr(recency, frequency) FROM rfm
UNION ALL SELECT 'recency', 'monetary', corr(recency, monetary) FROM rfm
UNION ALL SELECT 'frequency', 'monetary', corr(frequency, monetary) FROM rfm)
SELECT a, b, round(r, 6) AS r FROM pairs UNION ALL SELECT b, a, round(r, 6) FROM pairs
UNION ALL SELECT m, m, 1.0::DOUBLE FROM (VALUES ('recency'), ('frequency'), ('monetary')) AS d(m)
""")
def correlation_matrix(t: Tables):
    return rounded(quality.correlation_matrix(profile(t), MEASURES), "r")


def _edges(column: str) -> str:
    """Quintile edges by linear interpolation between the two rows around each."""
    return f"""
SELECT i, max(CASE WHEN rn = lo THEN v END) + (max(CASE WHEN rn = hi THEN v END)
          - max(CASE WHEN rn = lo THEN v END)) * max(pos - lo) AS edge
FROM (SELECT i, (n - 1) * i / 5.0::DOUBLE AS pos, floor((n - 1) * i / 5.0::DOUBLE) AS lo,
             least(floor((n - 1) * i / 5.0::DOUBLE) + 1, n - 1) AS hi
      FROM range(1, 5) AS r(i), (SELECT count(*) AS n FROM rfm))
JOIN (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {column}) - 1 AS rn FROM rfm)
ON rn = lo OR rn = hi GROUP BY i"""


SCORES_SQL = f"""
{RFM_SQL}, r_edges AS ({_edges('recency')}), m_edges AS ({_edges('monetary')}),
placed AS (SELECT *, row_number() OVER (ORDER BY frequency, o_custkey) AS place,
           count(*) OVER () AS n FROM rfm),
scored AS (SELECT o_custkey, recency, frequency, monetary,
  CAST(5 - (SELECT count(*) FROM r_edges WHERE edge < recency) AS INTEGER) AS score_recency,
  CAST(greatest(1, ceil((place - 1) * 5.0 / (n - 1))) AS INTEGER) AS score_frequency,
  CAST(1 + (SELECT count(*) FROM m_edges WHERE edge < monetary) AS INTEGER) AS score_monetary FROM placed)
"""


def scored(t: Tables):
    return profiles.rfm_scores(profile(t).select("o_custkey", *MEASURES), "o_custkey")


@proof(f"WITH {SCORES_SQL} SELECT * FROM scored")
def rfm_scores(t: Tables):
    return scored(t)


@proof(f"""
WITH {SCORES_SQL}
SELECT o_custkey, score_recency + score_frequency + score_monetary AS score_total FROM scored
""")
def rfm_total_score(t: Tables):
    return profiles.total_score(scored(t)).select("o_custkey", "score_total")
