"""Data quality and relationship reports over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopledger.functions.columns import percent, safe_ratio
from shopledger.functions.frames import (
    Relationship,
    duplicate_keys,
    flag_counts,
    orphans,
    row_counts,
)
from shopledger.sources.tables import ShopTables


def table_sizes(tables: ShopTables) -> DataFrame:
    return row_counts(tables.by_name())


def key_duplicates(tables: ShopTables) -> DataFrame:
    return duplicate_keys(
        {
            "orders.order_id": (tables.orders, "order_id"),
            "order_items.order_item_id": (tables.order_items, "order_item_id"),
            "customers.customer_id": (tables.customers, "customer_id"),
            "products.product_id": (tables.products, "product_id"),
        }
    )


def broken_relationships(tables: ShopTables) -> DataFrame:
    """Orphans per relationship. Only the customer of an order is optional."""
    t = tables
    return orphans(
        [
            Relationship(
                "orders -> customers",
                t.orders,
                "customer_id",
                t.customers,
                "customer_id",
                optional=True,
            ),
            Relationship(
                "order_items -> orders", t.order_items, "order_id", t.orders, "order_id"
            ),
            Relationship(
                "order_items -> products", t.order_items, "product_id", t.products, "product_id"
            ),
            Relationship("payments -> orders", t.payments, "order_id", t.orders, "order_id"),
            Relationship(
                "returns -> order_items",
                t.returns,
                "order_item_id",
                t.order_items,
                "order_item_id",
            ),
        ]
    )


def missing_values(orders: DataFrame) -> DataFrame:
    """Orders without a customer or a delivery time, in one row."""
    no_customer = F.col("customer_id").isNull()
    no_delivery = F.col("delivered_ts").isNull()
    delivered = F.col("order_status") == "delivered"
    counts = flag_counts(
        orders,
        "total_orders",
        {
            "missing_customer_id": no_customer,
            "missing_delivered_ts": no_delivery,
            "delivered_without_timestamp": delivered & no_delivery,
        },
    )
    share = safe_ratio(F.col("missing_customer_id"), F.col("total_orders"))
    return counts.select(
        "total_orders",
        "missing_customer_id",
        percent(share).alias("missing_customer_percent"),
        "missing_delivered_ts",
        "delivered_without_timestamp",
    )


def invalid_items(order_items: DataFrame) -> DataFrame:
    """Order lines with impossible quantities, prices, costs or discounts."""
    quantity, price = F.col("quantity"), F.col("unit_price_uah")
    cost, discount = F.col("unit_cost_uah"), F.col("item_discount_uah")
    return flag_counts(
        order_items,
        "total_order_items",
        {
            "invalid_quantity": quantity <= 0,
            "negative_price": price < 0,
            "negative_cost": cost < 0,
            "negative_discount": discount < 0,
            "discount_above_item_value": discount > price * quantity,
        },
    )
