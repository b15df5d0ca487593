"""Hand-made shops: rows given as dicts, missing columns are NULL."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from shopledger.sources.tables import SCHEMAS, ShopTables


def _value(value, kind):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.TimestampNTZType):
        return datetime.fromisoformat(value)
    return value


def table(spark, name, rows):
    schema = SCHEMAS[name]
    data = [tuple(_value(row.get(f.name), f.dataType) for f in schema) for row in rows]
    return spark.createDataFrame(data, schema)


def shop(spark, **rows):
    return ShopTables(lambda name: table(spark, name, rows.get(name, [])))


def order(order_id, **columns):
    return {
        "order_id": order_id,
        "customer_id": 1,
        "order_ts": "2025-10-05 10:00:00",
        "order_status": "delivered",
        "shipping_region": "Lviv",
        "delivered_ts": "2025-10-09 12:00:00",
        **columns,
    }


def item(item_id, order_id, **columns):
    return {
        "order_item_id": item_id,
        "order_id": order_id,
        "product_id": 7,
        "quantity": 1,
        "unit_price_uah": 100,
        "unit_cost_uah": 60,
        "item_discount_uah": 0,
        **columns,
    }


def payment(order_id, status="captured", amount=100, sequence=1, at="2025-10-05 10:05:00"):
    return {
        "order_id": order_id,
        "payment_sequence": sequence,
        "payment_status": status,
        "payment_amount_uah": amount,
        "payment_ts": at,
    }


def returned(item_id, order_id, status="completed", pieces=1, refund=100, at="2025-10-20 09:00:00"):
    return {
        "order_item_id": item_id,
        "order_id": order_id,
        "return_status": status,
        "returned_quantity": pieces,
        "refund_amount_uah": refund,
        "return_request_ts": at,
    }


def by_key(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


MART_ROW = (
    "order_id bigint, customer_id bigint, order_date date, order_month date, order_year int, "
    "normalized_shipping_region string, is_fulfilled_and_captured int, "
    "net_revenue_uah decimal(20,2), gross_profit_uah decimal(20,2), "
    "item_discount_uah decimal(20,2), item_sales_before_returns_uah decimal(20,2)"
)


def sale(order_id, day, customer=1, ok=1, revenue=100, profit=40, discount=10, region="Lviv"):
    day = datetime.fromisoformat(day).date()
    amounts = [Decimal(x) for x in (revenue, profit, discount, 90)]
    return (order_id, customer, day, day.replace(day=1), day.year, region, ok, *amounts)


def tiny_mart(spark, *sales):
    return spark.createDataFrame(list(sales), MART_ROW)
