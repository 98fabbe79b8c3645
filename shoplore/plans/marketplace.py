"""Cleaning the marketplace tables in dependency order, with an audit of what each step removed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.functions.columns import is_true
from shoplore.operators import cleaning
from shoplore.sources.files import add_reference_rows

# Spellings of the English category names, applied in this order. The space at the end
# of "telephone " is part of the name.
CATEGORY_RENAMES = [
    ("cine_photo", "cinema_picture"),
    ("costruction_tools_garden", "construction_tools_garden"),
    ("costruction_tools_tools", "construction_tools_tools"),
    ("fashion_underwear_beach", "fashion_underwear_beachwear"),
    ("fashio_female_clothing", "fashion_female_clothing"),
    ("fixed_telephony", "landline_telephone"),
    ("consoles_games", "console_games"),
    ("diapers_and_hygiene", "baby_diapers_and_hygiene"),
    ("dvds_blu_ray", "dvds_bluray"),
    ("fashion_childrens_clothes", "fashion_children_clothing"),
    ("home_appliances_2", "home_appliances_other"),
    ("home_comfort_2", "guest_house_other"),
    ("home_confort", "guest_house"),
    ("la_cuisine", "kitchenware_cookware"),
    ("market_place", "marketplace"),
    ("portable_kitchen_food_processors", "appliances_kitchen_food_processors"),
    ("security_and_services", "insurance_and_services"),
    ("signaling_and_security", "safety_and_signage"),
    ("small_appliances", "appliances_electronic"),
    ("small_appliances_home_oven_and_coffee", "appliances_home_oven_coffee"),
    ("tablets_printing_image", "tablet_image_printing"),
    ("telephony", "telephone "),
    ("arts_and_craftmanship", "arts_and_crafts"),
    ("construction_tools_tools", "construction_tools"),
]

# Category rows that the reference table lacks.
NOT_DEFINED = "Not Defined"
ADDED_CATEGORIES = [
    ("portateis_cozinha_e_preparadores_de_alimentos", "appliances_kitchen_food_processors"),
    ("pc_gamer", "pc_gamer"),
    (NOT_DEFINED, NOT_DEFINED),
]


@dataclass(frozen=True)
class Names:
    """What the tables' columns are called and which values mean what."""

    order: str = "order_id"
    order_customer: str = "cust_id"
    status: str = "order_status"
    delivered: str = "delivered"
    delivery_time: str = "order_cust_delivery_dtm"
    purchase_time: str = "order_purchase_dtm"
    order_day: str = "order_dt"
    unused_order_columns: Sequence[str] = ("order_approved_dtm", "order_carrier_delivery_dtm")
    customer: str = "cust_id"
    item_order: str = "order_id"
    item_product: str = "product_id"
    item_seller: str = "seller_id"
    product: str = "product_id"
    product_category: str = "category_name"
    unused_product_columns: Sequence[str] = (
        "name_length", "description_length", "photos_qty", "weight_g", "length_cm", "height_cm",
        "width_cm")
    seller: str = "seller_id"
    review_order: str = "order_id"
    review_texts: Sequence[str] = ("review_title", "review_message")
    payment_order: str = "order_id"
    category: str = "category_name"
    category_label: str = "category_name_en"
    added_categories: Sequence[tuple] = tuple(ADDED_CATEGORIES)
    category_renames: Sequence[tuple[str, str]] = tuple(CATEGORY_RENAMES)
    filler: str = NOT_DEFINED


Stage = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Cleaned:
    """The cleaned tables and what every deleting step did: ``(step, rows_before, rows_removed,
    rows_after)``. Both come from the same flagged rows."""

    tables: dict[str, DataFrame]
    audit: DataFrame


def _counted(flagged: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows before and after steps that delete one after another, from one pass over flagged rows."""
    stays, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, condition) in enumerate(steps, start=1):
        stays = stays & condition
        counts.append(F.count_if(stays).alias(f"n{i}"))
    rows = F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"n{i}").alias("rows_before"),
                              (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("rows_removed"),
                              F.col(f"n{i + 1}").alias("rows_after")) for i, (name, _) in enumerate(steps)])
    return flagged.agg(*counts).select(F.inline(rows))


def clean(tables: Mapping[str, DataFrame], names: Names = Names(), null_aware: bool = False,
          stage: Stage = lambda name, df: df) -> Cleaned:
    """Clean orders first, then what hangs on them, then what hangs on the items.

    ``tables`` holds ``orders`` and any of ``customer``, ``order_item``, ``payment``, ``review``,
    ``product``, ``seller`` and ``product_category``. Every table is flagged in one pass; what stays and
    the audit are read from the flags. Orders are read by several later steps and items by two; pass a
    ``stage`` that writes a flagged table and reads it back to have each worked out once, for the
    tables and the audit together. Items, payments and reviews of orders that go are found by a bitmap of the
    orders that stay and do not move.
    """
    n, done, audits = names, {}, []

    def flagged(name: str, rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
        stored = stage(name, rows)
        audits.append(_counted(stored, steps))
        for _, condition in steps:
            stored = stored.filter(condition)
        return stored.drop("__stays")

    start = cleaning.drop_columns(tables["orders"], n.unused_order_columns)
    done["orders"] = orders = flagged("orders", cleaning.with_date(start, n.purchase_time, n.order_day), [
        ("orders: no delivery time", F.col(n.delivery_time).isNotNull()),
        ("orders: not delivered", ~is_true(F.col(n.status) != n.delivered))])

    def drop_orphans(name: str, key: str, parent: DataFrame, parent_key: str, unique: bool,
                     table: DataFrame | None = None, salts: int = 1, sieve: bool = False) -> None:
        before = tables[name] if table is None else table
        done[name] = flagged(name, cleaning.with_parent_flag(
            before, parent, key, parent_key, null_aware, unique, salts, "__stays", sieve), [(f"{name}: orphans", F.col("__stays"))])

    if "customer" in tables:
        drop_orphans("customer", n.customer, orders, n.order_customer, False)
    for name, key in (("order_item", n.item_order), ("payment", n.payment_order)):
        if name in tables:
            drop_orphans(name, key, orders, n.order, True, sieve=True)
    if "review" in tables:
        filled = cleaning.fill_missing(tables["review"], {c: n.filler for c in n.review_texts})
        drop_orphans("review", n.review_order, orders, n.order, True, filled, sieve=True)
    items = done.get("order_item")
    if "product" in tables and items is not None:
        slim = cleaning.fill_missing(
            cleaning.drop_columns(tables["product"], n.unused_product_columns),
            {n.product_category: n.filler})
        drop_orphans("product", n.product, items, n.item_product, False, slim)
    if "seller" in tables and items is not None:
        drop_orphans("seller", n.seller, items, n.item_seller, False)
    if "product_category" in tables:
        complete = add_reference_rows(tables["product_category"], n.added_categories, n.category)
        done["product_category"] = stage("product_category", cleaning.rename_values(
            complete, n.category_label, n.category_renames))
    return Cleaned(done, reduce(DataFrame.unionByName, audits))


def clean_all(tables: Mapping[str, DataFrame], names: Names = Names(), null_aware: bool = False,
              stage: Stage = lambda name, df: df) -> dict[str, DataFrame]:
    """The tables of :func:`clean`."""
    return clean(tables, names, null_aware, stage).tables


def clean_audit(tables: Mapping[str, DataFrame], names: Names = Names(), null_aware: bool = False,
                stage: Stage = lambda name, df: df) -> DataFrame:
    """The audit of :func:`clean`."""
    return clean(tables, names, null_aware, stage).audit
