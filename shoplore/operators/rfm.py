"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplore.functions.columns import days_since, money
from shoplore.operators.ordered import exact_quantiles, place_bin, quantile_bin, with_row_number


@dataclass(frozen=True)
class Columns:
    """Column names of the tables that the profile is built from."""

    customer: str = "cust_id"
    order: str = "order_id"
    day: str = "order_dt"
    payment_order: str = "order_id"
    payment_value: str = "payment_value"
    customer_key: str = "cust_id"
    attributes: Sequence[str] = ("cust_zip_cd_prefix", "cust_city", "cust_state")


def frequency(orders: DataFrame, c: Columns = Columns()) -> DataFrame:
    return orders.groupBy(c.customer).agg(F.countDistinct(c.order).alias("frequency"))


def recency(orders: DataFrame, as_of: str, c: Columns = Columns(), mode: str = "latest") -> DataFrame:
    """Days since the latest order, or with ``mode="per_date"`` one row per order date."""
    if mode == "latest":
        return orders.groupBy(c.customer).agg(days_since(F.max(c.day), as_of).alias("recency"))
    if mode == "per_date":
        return orders.select(c.customer, days_since(c.day, as_of).alias("recency")).distinct()
    raise ValueError(f"mode is 'latest' or 'per_date', not {mode!r}")


def _paid(payments: DataFrame, c: Columns) -> DataFrame:
    """What was paid per order, added up first so that an order with very many payments sends one row
    per task."""
    return (payments.filter(F.col(c.payment_order).isNotNull())
            .groupBy(F.col(c.payment_order).alias(c.order))
            .agg(F.sum(money(c.payment_value)).alias("__paid"), F.lit(True).alias("__found")))


def payments_per_order(payments: DataFrame, c: Columns = Columns()) -> DataFrame:
    """Payments added up, one row per order under the same column names: what a stored table keyed by order holds, so
    that an order with very many payments does not fill a bucket. Payments without an order are left out."""
    return (payments.filter(F.col(c.payment_order).isNotNull()).groupBy(c.payment_order)
            .agg(F.sum(money(c.payment_value)).alias(c.payment_value)))


def monetary(orders: DataFrame, payments: DataFrame, c: Columns = Columns()) -> DataFrame:
    """Sum of a customer's payments; orders without a payment do not count. An order id that appears on
    several order rows counts once for each."""
    return (orders.select(c.customer, c.order).join(_paid(payments, c), c.order)
            .groupBy(c.customer).agg(F.sum("__paid").alias("monetary")))


def _per_order(orders: DataFrame, payments: DataFrame, c: Columns) -> DataFrame:
    """``(customer, order, __day, __paid, __found)``: one row per customer and order id."""
    return (orders.select(c.customer, c.order, c.day).join(_paid(payments, c), c.order, "left")
            .groupBy(c.customer, c.order)
            .agg(F.max(c.day).alias("__day"), F.sum("__paid").alias("__paid"),
                 F.max("__found").alias("__found")))


def rfm(orders: DataFrame, payments: DataFrame, customers: DataFrame, as_of: str,
        c: Columns = Columns(), mode: str = "latest", drop_nonpositive: bool = False) -> DataFrame:
    """One profile row per customer (one per customer and order date with ``mode="per_date"``).

    Orders and payments meet once, spread by order; what remains of them is one row per customer and
    order, summed up before it moves to its customer. Everything joined after that holds one row per
    customer (or per customer and date), so no key is hot.
    """
    bills = _per_order(orders, payments, c)
    visits = bills.groupBy(c.customer).agg(
        F.count(c.order).alias("frequency"), days_since(F.max("__day"), as_of).alias("recency"),
        F.sum("__paid").alias("monetary"), F.count("__found").alias("__found"))
    visits = visits.filter(F.col("__found") > 0).drop("__found")
    if drop_nonpositive:
        visits = visits.filter(F.col("monetary") > 0)
    if mode != "latest":
        visits = visits.drop("recency").join(recency(orders, as_of, c, mode), c.customer)
    # repeated rows are merged where they are, before anything moves
    who = customers.select(F.col(c.customer_key).alias(c.customer), *c.attributes).distinct()
    return (visits.join(who, c.customer)
            .select(c.customer, *c.attributes, "frequency", "recency", "monetary"))


def orders_in_categories(orders: DataFrame, items: DataFrame, products: DataFrame,
                         categories: Sequence[str], order: str, item_order: str, item_product: str,
                         product: str, category: str) -> DataFrame:
    """The orders with at least one item of the given categories."""
    wanted = products.filter(F.col(category).isin(list(categories))).select(product)
    hits = (items.select(F.col(item_order).alias(order), F.col(item_product).alias(product))
            .join(wanted, product, "left_semi").select(order).distinct())
    return orders.join(hits, order, "left_semi")


SCORES = ("score_recency", "score_frequency", "score_monetary")


def rfm_scores(profile: DataFrame, key: str, bins: int = 5) -> DataFrame:
    """Add quantile scores 1..bins: recent buyers, frequent buyers and high spenders score high.

    Frequency has few distinct values, so it is binned by its row number, ties in key order.
    """
    rising = list(range(1, bins + 1))
    probabilities = [i / bins for i in range(bins + 1)]
    numbered = with_row_number(profile, ["frequency", key], "__place")
    edges = exact_quantiles(numbered, ["recency", "monetary"], probabilities)
    total = numbered.count()
    return numbered.select(
        *profile.columns,
        quantile_bin("recency", edges["recency"], rising[::-1]).alias(SCORES[0]),
        place_bin(F.col("__place"), total, rising).alias(SCORES[1]),
        quantile_bin("monetary", edges["monetary"], rising).alias(SCORES[2]))


def total_score(scored: DataFrame, out: str = "score_total") -> DataFrame:
    """Sum of the three scores: 15 is the ideal customer, 3 the one at risk of leaving."""
    return scored.withColumn(out, sum(F.col(s) for s in SCORES))
