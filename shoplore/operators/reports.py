"""Business questions about orders, sellers, categories and places.

Grouped counts of distinct values are left to the optimizer's multi-stage aggregates, which merge equal
values before each shuffle and so spread a group however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.functions.columns import money
from shoplore.operators.cleaning import delete_orphans
from shoplore.operators.ordered import with_ranks
from shoplore.session import checkpointed


def enrich_items(items: DataFrame, products: DataFrame, categories: DataFrame,
                 product: str = "product_id", category: str = "category_name") -> DataFrame:
    """Items, all their columns, with their product's category and its translation; items without one stay.

    The names are joined to the products first, so that items without a category do not meet in one task.
    """
    goods = products.select(product, category).join(categories, category, "left")
    return items.join(goods, product, "left")


def distinct_counts(df: DataFrame, counts: Mapping[str, str]) -> DataFrame:
    """One row of ``{out: column}`` distinct counts."""
    return df.agg(*[F.countDistinct(c).alias(out) for out, c in counts.items()])


def distinct_counts_by(df: DataFrame, groups: Sequence[str | Column], counts: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.countDistinct(c).alias(out) for out, c in counts.items()])


def largest_first(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *ties)


def orders_per_seller(items: DataFrame, seller: str, order: str) -> DataFrame:
    return largest_first(distinct_counts_by(items, [seller], {"orders_cnt": order}), "orders_cnt", seller)


def sellers_per_order(items: DataFrame, order: str, seller: str) -> DataFrame:
    return distinct_counts_by(items, [order], {"num_sellers": seller})


def orders_by_month(orders: DataFrame, day: str, order: str) -> DataFrame:
    """``(year, month, month_start, orders_cnt)`` in time order."""
    groups = [F.year(day).alias("year"), F.month(day).alias("month")]
    return (distinct_counts_by(orders, groups, {"orders_cnt": order})
            .select("year", "month", F.make_date("year", "month", F.lit(1)).alias("month_start"),
                    "orders_cnt")
            .orderBy("year", "month"))


def orders_by_year(orders: DataFrame, day: str, order: str) -> DataFrame:
    return distinct_counts_by(orders, [F.year(day).alias("year")], {"orders_cnt": order}).orderBy("year")


def orders_by_place(orders: DataFrame, customers: DataFrame, places: DataFrame, by: Sequence[str],
                    order: str, customer: str, customer_key: str, place: str, place_key: str) -> DataFrame:
    """Distinct orders by any columns of the places their customers live in, largest first. Repeated rows of
    orders and customers are merged below the joins."""
    homes = customers.select(F.col(customer_key).alias("__customer"), F.col(place).alias("__place")).distinct()
    bought = orders.select(order, F.col(customer).alias("__customer")).distinct()
    sited = bought.join(homes, "__customer").join(places, F.col("__place") == F.col(place_key))
    return largest_first(distinct_counts_by(sited, by, {"orders_cnt": order}), "orders_cnt", *by)


def category_sales(items: DataFrame, products: DataFrame, categories: DataFrame | None, by: Sequence[str],
                   order: str, product: str, product_key: str, category: str, price: str) -> DataFrame:
    """Distinct orders and revenue by category columns. ``categories`` keeps products of known
    categories and adds its columns."""
    goods = products.select(F.col(product_key).alias("__product"), category)
    if categories is not None:
        goods = goods.join(categories, category)
    sold = (items.select(order, F.col(product).alias("__product"), money(price).alias("__price"))
            .join(goods, "__product"))
    return sold.groupBy(*by).agg(F.countDistinct(order).alias("orders_cnt"),
                                 F.sum("__price").alias("revenue"))


def rank_categories(sales: DataFrame, name: str, top: int | None = 10) -> DataFrame:
    """``(name, pop_ranking, rev_ranks)``; the limit follows popularity, then name."""
    ranked = with_ranks(sales.select(name, "orders_cnt", "revenue"),
                        {"pop_ranking": ("orders_cnt", True), "rev_ranks": ("revenue", True)})
    ordered = ranked.select(name, "pop_ranking", "rev_ranks").orderBy("pop_ranking", name)
    return ordered if top is None else ordered.limit(top)


def _goods(products: DataFrame, categories: DataFrame, product: str, product_key: str, category: str,
           columns: Sequence[str]) -> DataFrame:
    """Products of known categories, under the items' name for their key, with columns of the category."""
    return (products.select(F.col(product_key).alias(product), category)
            .join(categories, category).select(product, *columns).distinct())


def seller_specialisation(items: DataFrame, products: DataFrame, categories: DataFrame, seller: str,
                          product: str, product_key: str, category: str, label: str) -> DataFrame:
    """Distinct categories, by their ``label``, and products per seller, over products of known categories.
    Repeated sales of a product by a seller are merged before the join."""
    goods = _goods(products, categories, product, product_key, category, [label])
    sold = items.select(seller, product).distinct().join(goods, product)
    counts = distinct_counts_by(sold, [seller], {"categories_cnt": label, "products_cnt": product})
    return largest_first(counts, "products_cnt", seller)


def sellers_per_category(items: DataFrame, products: DataFrame, categories: DataFrame, seller: str,
                         product: str, product_key: str, category: str, label: str) -> DataFrame:
    """Distinct sellers per ``label`` of the known categories."""
    goods = _goods(products, categories, product, product_key, category, [label])
    sold = items.select(seller, product).distinct().join(goods, product)
    return largest_first(distinct_counts_by(sold, [label], {"sellers_cnt": seller}), "sellers_cnt", label)


def orders_over_sellers(items: DataFrame, products: DataFrame, categories: DataFrame, wanted: Sequence[str],
                        seller: str, order: str, product: str, product_key: str, category: str, label: str,
                        more_than: int = 0) -> DataFrame:
    """One row about the sellers with more than ``more_than`` orders in the categories with one of the
    wanted labels: how many they are, their orders added up (an order of several sellers counts for each), and their distinct
    orders. Items without a seller are left out."""
    named = categories.filter(F.col(label).isin(list(wanted)))
    goods = _goods(products, named, product, product_key, category, [])
    pairs = (items.filter(F.col(seller).isNotNull()).select(seller, order, product)
             .join(goods, product, "left_semi").select(seller, order).distinct())
    if more_than > 0:
        # read twice below, and worth storing: it is what the items come down to
        pairs = checkpointed(pairs)
    sellers = (pairs.groupBy(seller).agg(F.count(order).alias("num_orders"))
               .filter(F.col("num_orders") > more_than))
    kept = pairs
    if more_than > 0:
        kept = delete_orphans(pairs, sellers, seller, parent_unique=True, salts=8)
    return sellers.agg(
        F.count(F.lit(1)).alias("sellers_cnt"),
        F.sum("num_orders").alias("orders_summed_over_sellers")).withColumn(
        "distinct_orders", kept.agg(F.countDistinct(order)).scalar())


def zero_payments(payments: DataFrame, value: str) -> DataFrame:
    return payments.filter(F.col(value) == 0)


def lowest_price(items: DataFrame, price: str) -> DataFrame:
    return items.agg(F.min(price).alias("min_price"))
