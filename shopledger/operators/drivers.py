"""What moved profitability: discounts and product categories.

These work on item values and returns, not on payments, so their gross profit
is a different figure from the mart's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopledger.config import AnalysisConfig
from shopledger.functions.columns import (
    cents,
    from_cents,
    growth_direction,
    month_in,
    on_or_before,
    percent,
    safe_ratio,
    total,
)
from shopledger.functions.frames import left_join_spread, pivot_max
from shopledger.operators.kpis import successful


def successful_period_orders(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(order_id, order_year) of the successful orders in the comparison months."""
    in_period = month_in(F.col("order_month"), cfg.period_starts(*cfg.years))
    return mart.filter(in_period & successful()).select("order_id", "order_year")


def discount_scenario(mart: DataFrame, order_items: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Current-year sales valued at last year's discount rate; one row.

    Items are summed per order before they meet the mart. No row comes out when
    either year has no sales.
    """
    per_order = order_items.groupBy("order_id").agg(
        F.sum(cents(F.col("unit_price_uah")) * F.col("quantity")).alias("sales"),
        F.sum(cents(F.col("item_discount_uah"))).alias("discount"),
    )
    per_year = (
        successful_period_orders(mart, cfg)
        .join(per_order, "order_id")
        .groupBy("order_year")
        .agg(*[total(F.sum(from_cents(F.col(c)))).alias(c) for c in ("sales", "discount")])
        .withColumn("rate", safe_ratio(F.col("discount"), F.col("sales")))
    )
    current, previous = cfg.current_year, cfg.previous_year
    both = pivot_max(
        per_year,
        [],
        "order_year",
        {
            "has_current": (current, "order_year"),
            "has_previous": (previous, "order_year"),
            "sales": (current, "sales"),
            "discount": (current, "discount"),
            "rate": (current, "rate"),
            "rate_before": (previous, "rate"),
        },
    ).filter(F.col("has_current").isNotNull() & F.col("has_previous").isNotNull())
    at_old_rate = F.col("sales").cast("double") * F.col("rate_before")
    return both.select(
        total(F.round("sales", 2)).alias(f"sales_{current}_before_discount_uah"),
        percent(F.col("rate_before")).alias(f"discount_rate_{previous}_percent"),
        percent(F.col("rate")).alias(f"discount_rate_{current}_percent"),
        total(F.round("discount", 2)).alias(f"actual_discount_{current}_uah"),
        F.round(at_old_rate, 2).alias(f"discount_at_{previous}_rate_uah"),
        F.round(F.col("discount").cast("double") - at_old_rate, 2).alias(
            "incremental_discount_scenario_uah"
        ),
    )


def completed_returns_by_item(returns: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    completed = (F.col("return_status") == "completed") & on_or_before(
        F.col("return_request_ts"), cfg.cutoff
    )
    return (
        returns.filter(completed)
        .groupBy("order_item_id")
        .agg(
            F.sum("returned_quantity").alias("returned_pieces"),
            F.sum(cents(F.col("refund_amount_uah"))).alias("refunded"),
        )
    )


def _item_values() -> dict[str, Column]:
    """Sales before discount, discount, net sales and net cost of one line, in cents."""
    quantity, cost = F.col("quantity"), cents(F.col("unit_cost_uah"))
    value = cents(F.col("unit_price_uah")) * quantity
    discount = cents(F.col("item_discount_uah"))
    refunded = F.coalesce("refunded", F.lit(0))
    returned = F.coalesce("returned_pieces", F.lit(0))
    return {
        "sales": value,
        "discount": discount,
        "net_sales": value - discount - refunded,
        "net_cost": cost * quantity - cost * returned,
    }


def category_totals(
    mart: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    cfg: AnalysisConfig,
) -> DataFrame:
    """Item-based money per category and year over the period's successful orders.

    The period's orders cut the items down before anything else is joined, and
    the lines are summed per product before products are joined, so a
    best-seller reaches that join as one row per year.

    ``profit`` leaves out a line with an unknown price, discount or cost as a
    whole; ``net_sales`` and ``net_cost`` are summed apart, so there an unknown
    cost only leaves out that cost.
    """
    values = _item_values()
    values["profit"] = values["net_sales"] - values["net_cost"]
    sold = order_items.join(successful_period_orders(mart, cfg), "order_id")
    lines = left_join_spread(
        sold, completed_returns_by_item(returns, cfg), "order_item_id", "order_id"
    )
    per_product = lines.groupBy("product_id", "order_year").agg(
        *[F.sum(value).alias(name) for name, value in values.items()]
    )
    return (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "order_year")
        .agg(*[total(F.sum(from_cents(F.col(name)))).alias(name) for name in values])
    )


def category_profit_change(totals: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Gross profit per category in both years, the change and its direction."""
    current, previous = cfg.current_year, cfg.previous_year
    both = pivot_max(
        totals,
        ["category"],
        "order_year",
        {"profit": (current, "profit"), "profit_before": (previous, "profit")},
    )
    profit, before = F.col("profit"), F.col("profit_before")
    return both.select(
        "category",
        total(F.round(before, 2)).alias(f"gross_profit_{previous}_uah"),
        total(F.round(profit, 2)).alias(f"gross_profit_{current}_uah"),
        total(F.round(profit - before, 2)).alias("gross_profit_change_uah"),
        growth_direction(profit, before).alias("profit_change_direction"),
    ).orderBy(F.col("gross_profit_change_uah").desc_nulls_last())


def category_summary(totals: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Dashboard form: profit, discount rates and margin per category as fractions."""
    current, previous = cfg.current_year, cfg.previous_year
    profit = total(F.col("net_sales") - F.col("net_cost"))
    rated = totals.withColumns(
        {
            "profit": profit,
            "discount_rate": safe_ratio(F.col("discount"), F.col("sales")),
            "margin": safe_ratio(profit, F.col("net_sales")),
        }
    )
    both = pivot_max(
        rated,
        ["category"],
        "order_year",
        {
            f"gross_profit_{previous}_uah": (previous, "profit"),
            f"gross_profit_{current}_uah": (current, "profit"),
            f"discount_rate_{previous}_percent": (previous, "discount_rate"),
            f"discount_rate_{current}_percent": (current, "discount_rate"),
            f"gross_margin_{current}_percent": (current, "margin"),
        },
    )
    now, before = F.col(f"gross_profit_{current}_uah"), F.col(f"gross_profit_{previous}_uah")
    return both.select(
        "category",
        before,
        now,
        total(now - before).alias("gross_profit_change_uah"),
        f"discount_rate_{previous}_percent",
        f"discount_rate_{current}_percent",
        f"gross_margin_{current}_percent",
        growth_direction(now, before).alias("category_result"),
    ).orderBy(F.col("gross_profit_change_uah").desc_nulls_last())
