"""Order-grain aggregates of items, payments and returns.

Each is reduced to one row per order before anything is joined, so items,
payments and returns of one order never multiply each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopledger.config import AnalysisConfig
from shopledger.functions.columns import (
    cents,
    count_where,
    from_cents,
    latest_by,
    on_or_before,
    sum_where,
)
from shopledger.functions.frames import left_join_spread


def items_by_order(order_items: DataFrame) -> DataFrame:
    """Lines, products, pieces, discount, sales, cost and gross profit per order."""
    quantity, discount = F.col("quantity"), cents(F.col("item_discount_uah"))
    value = cents(F.col("unit_price_uah")) * quantity
    cost = cents(F.col("unit_cost_uah")) * quantity
    return order_items.groupBy("order_id").agg(
        F.count("*").alias("order_lines_count"),
        F.count_distinct("product_id").alias("distinct_products_count"),
        F.sum(quantity).alias("sold_quantity"),
        from_cents(F.sum(discount)).alias("item_discount_uah"),
        from_cents(F.sum(value - discount)).alias("item_sales_before_returns_uah"),
        from_cents(F.sum(cost)).alias("item_cost_before_returns_uah"),
        from_cents(F.sum(value - discount - cost)).alias(
            "item_gross_profit_before_returns_uah"
        ),
    )


def payments_by_order(payments: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Payment events up to the cutoff: counts and amounts by status, latest status."""
    status, amount = F.col("payment_status"), cents(F.col("payment_amount_uah"))
    at = F.col("payment_ts")

    def has(name: str):
        return status == name

    signed = (
        F.when(has("captured"), amount)
        .when(status.isin("refunded", "chargeback"), -amount)
        .otherwise(F.lit(0))
    )
    return (
        payments.filter(on_or_before(at, cfg.cutoff))
        .groupBy("order_id")
        .agg(
            F.count("*").alias("payment_events_count"),
            count_where(has("captured")).alias("captured_events"),
            count_where(has("failed")).alias("failed_events"),
            count_where(has("pending")).alias("pending_events"),
            count_where(has("refunded")).alias("refunded_events"),
            count_where(has("chargeback")).alias("chargeback_events"),
            from_cents(sum_where(has("captured"), amount)).alias("captured_amount_uah"),
            from_cents(sum_where(has("refunded"), amount)).alias("payment_refunded_uah"),
            from_cents(sum_where(has("chargeback"), amount)).alias("chargeback_uah"),
            from_cents(F.sum(signed)).alias("retained_payment_uah"),
            latest_by(status, F.col("payment_sequence"), at).alias("latest_payment_status"),
            F.max(at).alias("last_payment_ts"),
        )
    )


def returns_by_order(
    returns: DataFrame, order_items: DataFrame, cfg: AnalysisConfig
) -> DataFrame:
    """Return requests up to the cutoff and the cost of the goods that came back.

    A return row counts once per item row carrying its item id (once if there is
    none). Only items that were returned are kept: their rows meet the returned ids
    as they are, as few share an id. They are collapsed to how many share an id and
    what they cost together, so copies of an id are multiplied out by arithmetic, not
    by joining every pair.
    """
    status, quantity = F.col("return_status"), F.col("returned_quantity")
    refund = cents(F.col("refund_amount_uah"))
    completed = status == "completed"
    requests = returns.filter(on_or_before(F.col("return_request_ts"), cfg.cutoff))
    returned = requests.select("order_item_id").distinct()
    items = order_items.join(returned, "order_item_id", "left_semi")
    item_copies = items.groupBy("order_item_id").agg(
        F.count("*").alias("copies"), F.sum(cents(F.col("unit_cost_uah"))).alias("unit_costs")
    )
    matched = left_join_spread(
        requests, item_copies, "order_item_id", "order_id", "return_request_ts"
    )
    copies = F.coalesce("copies", F.lit(1))

    def requests_where(condition: Column) -> Column:
        return sum_where(condition, copies)

    return matched.groupBy("order_id").agg(
        F.sum(copies).alias("return_requests_count"),
        requests_where(status == "requested").alias("requested_returns"),
        requests_where(status == "approved").alias("approved_returns"),
        requests_where(completed).alias("completed_returns"),
        requests_where(status == "rejected").alias("rejected_returns"),
        sum_where(completed, quantity * copies).alias("returned_quantity"),
        from_cents(sum_where(completed, refund * copies)).alias("completed_refund_uah"),
        # The cost of an unknown item is unknown and left out; its refund is not.
        from_cents(sum_where(completed, quantity * F.col("unit_costs"))).alias(
            "returned_item_cost_uah"
        ),
        F.max("return_request_ts").alias("last_return_request_ts"),
    )
