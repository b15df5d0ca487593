"""The order mart: one row per order with payments, returns and profitability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from shopledger.config import AnalysisConfig
from shopledger.functions.columns import (
    MONEY,
    calendar_columns,
    flag,
    money,
    normalize_label,
    on_or_before,
    percent,
    safe_ratio,
    within_days,
    zero_if_null,
)
from shopledger.functions.frames import left_join_spread
from shopledger.operators.order_facts import (
    items_by_order,
    payments_by_order,
    returns_by_order,
)
from shopledger.sources.tables import ShopTables

ITEM_MEASURES = (
    "order_lines_count",
    "distinct_products_count",
    "sold_quantity",
    "item_discount_uah",
    "item_sales_before_returns_uah",
    "item_cost_before_returns_uah",
    "item_gross_profit_before_returns_uah",
)
PAYMENT_MEASURES = (
    "payment_events_count",
    "captured_events",
    "failed_events",
    "pending_events",
    "refunded_events",
    "chargeback_events",
    "captured_amount_uah",
    "payment_refunded_uah",
    "chargeback_uah",
    "retained_payment_uah",
)
RETURN_MEASURES = (
    "return_requests_count",
    "requested_returns",
    "approved_returns",
    "completed_returns",
    "rejected_returns",
    "returned_quantity",
    "completed_refund_uah",
    "returned_item_cost_uah",
)

# The mart's columns in order: the order itself, its measures, the outcome.
BASE_COLUMNS = (
    "order_id",
    "customer_id",
    "order_ts",
    "order_date",
    "order_month",
    "order_year",
    "order_status",
    "order_channel",
    "device_type",
    "shipping_region",
    "normalized_shipping_region",
    "shipping_city",
    "shipping_fee_uah",
    "promised_delivery_ts",
    "delivered_ts",
    "is_guest_checkout",
    "acquisition_channel",
    "loyalty_tier",
    "customer_home_region",
    "customer_home_city",
    "birth_year",
    "signup_ts",
    "is_delivered_by_cutoff",
    "has_order_items",
    *ITEM_MEASURES,
    *PAYMENT_MEASURES,
    "latest_payment_status",
    "last_payment_ts",
    *RETURN_MEASURES,
    "last_return_request_ts",
)
MART_COLUMNS = (
    *BASE_COLUMNS,
    "net_revenue_uah",
    "net_item_cost_uah",
    "net_sold_quantity",
    "gross_profit_uah",
    "is_fulfilled_and_captured",
    "is_retained_sale",
    "is_fully_reversed_sale",
    "gross_margin_percent",
)


_KINDS: dict[str, T.DataType] = {
    **dict.fromkeys(("order_id", "customer_id", "net_sold_quantity"), T.LongType()),
    **dict.fromkeys(("order_date", "order_month"), T.DateType()),
    **dict.fromkeys(("order_year", "birth_year"), T.IntegerType()),
    "shipping_fee_uah": T.DecimalType(18, 2),
    "gross_margin_percent": T.DoubleType(),
}


def _kind(name: str) -> T.DataType:
    if name in _KINDS:
        return _KINDS[name]
    if name.endswith("_uah"):
        return MONEY
    if name.endswith("_ts"):
        return T.TimestampNTZType()
    if name.startswith(("is_", "has_")):
        return T.IntegerType()
    measures = (*ITEM_MEASURES, *PAYMENT_MEASURES, *RETURN_MEASURES)
    return T.LongType() if name in measures else T.StringType()


# The types of a stored mart, which an empty one cannot tell by itself.
MART_SCHEMA = T.StructType(
    [T.StructField(name, _kind(name)) for name in MART_COLUMNS]
)


def orders_in_window(orders: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Orders placed inside the window; the range reaches the scan."""
    return orders.filter(within_days(F.col("order_ts"), cfg.window_start, cfg.window_end))


def with_order_calendar(orders: DataFrame) -> DataFrame:
    return orders.withColumns(calendar_columns(F.col("order_ts")))


def with_normalized_region(orders: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    region = normalize_label(F.col("shipping_region"), cfg.region_names)
    return orders.withColumn("normalized_shipping_region", region)


def with_guest_flag(orders: DataFrame) -> DataFrame:
    return orders.withColumn("is_guest_checkout", flag(F.col("customer_id").isNull()))


def with_delivered_flag(orders: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Delivered, and the delivery time is known and not after the cutoff."""
    delivered = (F.col("order_status") == "delivered") & on_or_before(
        F.col("delivered_ts"), cfg.cutoff
    )
    return orders.withColumn("is_delivered_by_cutoff", flag(delivered))


def with_customers(orders: DataFrame, customers: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Customer attributes and the acquisition label.

    Joined while order rows are still narrow. Guests, who may be a large part of
    all orders, are scattered over the tasks instead of meeting on NULL.
    """
    attributes = customers.select(
        "customer_id",
        F.col("acquisition_channel").alias("customer_channel"),
        "loyalty_tier",
        F.col("home_region").alias("customer_home_region"),
        F.col("home_city").alias("customer_home_city"),
        "birth_year",
        "signup_ts",
    )
    label = F.when(F.col("customer_id").isNull(), cfg.guest_label).otherwise(
        F.coalesce("customer_channel", F.lit(cfg.unknown_channel_label))
    )
    return (
        left_join_spread(orders, attributes, "customer_id", "order_id")
        .withColumn("acquisition_channel", label)
        .drop("customer_channel")
    )


def rows_of_orders(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows that belong to any of the orders, to be aggregated by order.

    They meet the ids of the orders before they are aggregated, so they cross one shuffle as they
    are and are grouped where they lie, by order and any finer key. Combining them before the
    shuffle would keep about every row of a task in its hash table, where few rows share a key, and
    spill it; AQE splits a hot order at this join.
    """
    wanted = orders.select(F.col("order_id").alias("wanted_order_id"))
    return rows.join(wanted, rows["order_id"] == wanted["wanted_order_id"], "left_semi")


def facts_of_orders(*facts: DataFrame) -> DataFrame:
    """Order-grain aggregates as one row for each order that has any; absent measures are NULL.

    Each arrives partitioned by order with one row per order. A union of equally partitioned
    tables keeps the partitioning, so one grouping puts the rows of an order together where they
    lie. A full join would lose it, and move what it joined once more for the next one.
    """
    if len(facts) == 1:
        return facts[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    measures = [name for name in stacked.columns if name != "order_id"]
    # One row at most has a measure, so its maximum is that row's.
    return stacked.groupBy("order_id").agg(*[F.max(name).alias(name) for name in measures])


def with_order_facts(orders: DataFrame, items: DataFrame, *others: DataFrame) -> DataFrame:
    """Attach order-grain aggregates, of items and of any others; absent measures stay NULL.

    Orders and facts meet between two fresh shuffles, which AQE splits where one order id, or
    none, is held by many rows. The facts move once more for it: one row per order.
    """
    facts = facts_of_orders(items, *others)
    return left_join_spread(orders, facts, "order_id", "order_ts", "customer_id").withColumn(
        "has_order_items", flag(F.col("order_lines_count").isNotNull())
    )


def with_zero_filled_measures(orders: DataFrame) -> DataFrame:
    """0 for orders without items, payments or returns.

    The latest payment status and the two last timestamps stay NULL.
    """
    measures = (*ITEM_MEASURES, *PAYMENT_MEASURES, *RETURN_MEASURES)
    money_measures = [m for m in measures if m.endswith("_uah")]
    return orders.withColumns(
        {
            m: money(zero_if_null(F.col(m))) if m in money_measures else zero_if_null(F.col(m))
            for m in measures
        }
    )


def order_base(tables: ShopTables, cfg: AnalysisConfig) -> DataFrame:
    """Orders of the window with customer, labels, flags and zero-filled measures."""
    orders = orders_in_window(tables.orders, cfg)
    items = rows_of_orders(tables.order_items, orders)
    orders = with_customers(orders, tables.customers, cfg)
    orders = with_order_facts(
        orders,
        items_by_order(items),
        payments_by_order(tables.payments, cfg),
        returns_by_order(tables.returns, tables.order_items, cfg),
    )
    orders = with_zero_filled_measures(orders)
    orders = with_order_calendar(orders)
    orders = with_normalized_region(orders, cfg)
    orders = with_guest_flag(orders)
    orders = with_delivered_flag(orders, cfg)
    return orders.select(*BASE_COLUMNS)


def order_financials(base: DataFrame) -> DataFrame:
    """Net revenue, cost and quantity; all 0 unless delivered by the cutoff."""
    delivered = F.col("is_delivered_by_cutoff") == 1

    def if_delivered(gained: str, lost: str):
        return F.when(delivered, F.col(gained) - F.col(lost)).otherwise(F.lit(0))

    return base.withColumns(
        {
            "net_revenue_uah": money(
                if_delivered("retained_payment_uah", "completed_refund_uah")
            ),
            "net_item_cost_uah": money(
                if_delivered("item_cost_before_returns_uah", "returned_item_cost_uah")
            ),
            "net_sold_quantity": if_delivered("sold_quantity", "returned_quantity"),
        }
    )


def order_metrics(financials: DataFrame) -> DataFrame:
    """Gross profit and what became of the sale."""
    delivered = F.col("is_delivered_by_cutoff") == 1
    captured = F.col("captured_events") > 0
    revenue = F.col("net_revenue_uah")
    return financials.withColumns(
        {
            "gross_profit_uah": money(revenue - F.col("net_item_cost_uah")),
            "is_fulfilled_and_captured": flag(delivered & captured),
            "is_retained_sale": flag(delivered & (revenue > 0)),
            "is_fully_reversed_sale": flag(delivered & captured & (revenue <= 0)),
        }
    )


def with_gross_margin(metrics: DataFrame) -> DataFrame:
    """Gross margin in percent, only where there is net revenue."""
    revenue = F.col("net_revenue_uah")
    margin = percent(safe_ratio(F.col("gross_profit_uah"), revenue))
    return metrics.withColumn("gross_margin_percent", F.when(revenue > 0, margin))


def mart_from_base(base: DataFrame) -> DataFrame:
    return with_gross_margin(order_metrics(order_financials(base))).select(*MART_COLUMNS)


def order_level_mart(tables: ShopTables, cfg: AnalysisConfig) -> DataFrame:
    """The mart, unsorted; see :func:`in_report_order` and the mart writer."""
    return mart_from_base(order_base(tables, cfg))


def in_report_order(mart: DataFrame) -> DataFrame:
    """Sorted by order time for reading; a stored mart keeps its own layout."""
    return mart.orderBy(F.col("order_ts").asc_nulls_first(), F.col("order_id").asc_nulls_first())
