"""Regional actuals against monthly targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopledger.config import AnalysisConfig
from shopledger.functions.columns import (
    count_where,
    month_in,
    percent,
    target_attainment,
    target_status,
    total,
    zero_if_null,
)
from shopledger.operators.kpis import successful


def region_actuals(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Orders and gross profit per region over all orders of the current period."""
    in_period = month_in(F.col("order_month"), cfg.period_starts(cfg.current_year))
    return (
        mart.filter(in_period)
        .groupBy(F.col("normalized_shipping_region").alias("region"))
        .agg(
            F.count("*").alias("orders_actual"),
            count_where(successful()).alias("successful_orders"),
            total(F.sum("gross_profit_uah")).alias("gross_profit_actual_uah"),
        )
    )


def region_goals(monthly_targets: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Targets per region, from the first to the last comparison month."""
    months = cfg.period_starts(cfg.current_year)
    month = F.to_date("month", "yyyy-M")
    return (
        monthly_targets.filter(month.between(F.lit(months[0]), F.lit(months[-1])))
        .groupBy("region")
        .agg(
            F.sum("orders_target").alias("orders_target"),
            total(F.sum("gross_profit_target_uah")).alias("gross_profit_target_uah"),
        )
    )


def goals_with_actuals(
    mart: DataFrame, monthly_targets: DataFrame, cfg: AnalysisConfig
) -> DataFrame:
    """Every region with a target; regions without orders have NULL actuals."""
    return region_goals(monthly_targets, cfg).join(region_actuals(mart, cfg), "region", "left")


def region_targets(
    mart: DataFrame, monthly_targets: DataFrame, cfg: AnalysisConfig
) -> DataFrame:
    orders, orders_goal = F.col("orders_actual"), F.col("orders_target")
    profit, profit_goal = F.col("gross_profit_actual_uah"), F.col("gross_profit_target_uah")
    return (
        goals_with_actuals(mart, monthly_targets, cfg)
        .select(
            "region",
            orders,
            orders_goal,
            percent(target_attainment(orders, orders_goal)).alias(
                "orders_target_attainment_percent"
            ),
            total(F.round(profit, 2)).alias("gross_profit_actual_uah"),
            total(F.round(profit_goal, 2)).alias("gross_profit_target_uah"),
            percent(target_attainment(profit, profit_goal)).alias(
                "gross_profit_target_attainment_percent"
            ),
        )
        .orderBy(F.col("orders_target_attainment_percent").desc_nulls_last())
    )


def region_summary(
    mart: DataFrame, monthly_targets: DataFrame, cfg: AnalysisConfig
) -> DataFrame:
    """Dashboard form: zero-filled actuals, attainment as fractions, and the status."""
    orders, orders_goal = zero_if_null(F.col("orders_actual")), F.col("orders_target")
    profit = total(zero_if_null(F.col("gross_profit_actual_uah")))
    profit_goal = F.col("gross_profit_target_uah")
    return (
        goals_with_actuals(mart, monthly_targets, cfg)
        .select(
            "region",
            orders.alias("orders_actual"),
            zero_if_null(F.col("successful_orders")).alias("successful_orders"),
            orders_goal,
            target_attainment(orders, orders_goal).alias("orders_target_attainment_percent"),
            profit.alias("gross_profit_actual_uah"),
            profit_goal,
            target_attainment(profit, profit_goal).alias(
                "gross_profit_target_attainment_percent"
            ),
            target_status(orders, orders_goal, profit, profit_goal).alias("target_status"),
        )
        .orderBy(F.col("orders_target_attainment_percent").desc_nulls_last())
    )
