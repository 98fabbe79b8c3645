"""Declared schemas of the marketplace tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()
_TIME = T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Table and column names and types.
SCHEMAS: dict[str, T.StructType] = {
    "customer": _schema(
        cust_id=_STRING, cust_unique_id=_STRING, cust_zip_cd_prefix=_STRING,
        cust_city=_STRING, cust_state=_STRING),
    "geolocation": _schema(
        zip_cd_prefix=_STRING, geoloc_lat=_STRING, geoloc_long=_STRING,
        geoloc_city=_STRING, geoloc_state=_STRING),
    "orders": _schema(
        order_id=_STRING, cust_id=_STRING, order_status=_STRING, order_purchase_dtm=_TIME,
        order_approved_dtm=_TIME, order_carrier_delivery_dtm=_TIME,
        order_cust_delivery_dtm=_TIME, order_estm_delivery_dtm=_TIME),
    "order_item": _schema(
        order_id=_STRING, order_item_id=T.DecimalType(5, 0), product_id=_STRING,
        seller_id=_STRING, shipping_limit_dtm=_TIME, product_price=T.DecimalType(10, 2),
        product_ship_fee=T.DecimalType(10, 2)),
    "product_category": _schema(category_name=_STRING, category_name_en=_STRING),
    "product": _schema(
        product_id=_STRING, category_name=_STRING, name_length=T.DecimalType(5, 0),
        description_length=T.DecimalType(10, 0), photos_qty=T.DecimalType(5, 0),
        weight_g=T.DecimalType(10, 0), length_cm=T.DecimalType(5, 0),
        height_cm=T.DecimalType(5, 0), width_cm=T.DecimalType(5, 0)),
    "seller": _schema(
        seller_id=_STRING, seller_zip_cd_prefix=_STRING, seller_city=_STRING,
        seller_state=_STRING),
    "review": _schema(
        review_id=_STRING, order_id=_STRING, review_score=T.DecimalType(2, 0),
        review_title=_STRING, review_message=_STRING, review_dtm=_TIME,
        review_response_dtm=_TIME),
    "geolocation_state": _schema(
        geoloc_state=_STRING, geoloc_state_name=_STRING, geoloc_region=_STRING,
        geoloc_state_pop=T.DecimalType(15, 2)),
    "payment": _schema(
        order_id=_STRING, payment_sequential=T.DecimalType(5, 0), payment_type=_STRING,
        payment_installments=T.DecimalType(5, 0), payment_value=T.DecimalType(10, 2)),
}
