"""Year-over-year KPIs, monthly growth and customer mix over the mart.

Analysis reports give ratios in percent, dashboard extracts the bare fraction;
both are built on the same aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopledger.config import AnalysisConfig
from shopledger.functions.columns import (
    change_on_previous_row,
    count_where,
    month_in,
    percent,
    relative_change,
    safe_ratio,
    share_of_total,
    step_from_previous_row,
    sum_where,
    total,
)
from shopledger.functions.frames import first_event_cohort, pair_months

SUCCESSFUL = "is_fulfilled_and_captured"


def successful() -> Column:
    return F.col(SUCCESSFUL) == 1


def sale_measures() -> dict[str, Column]:
    """Order counts and the money of successful orders, as aggregates."""
    ok, discount = successful(), F.col("item_discount_uah")
    before_discount = F.col("item_sales_before_returns_uah") + discount
    return {
        "created_orders": F.count("*"),
        "successful_orders": count_where(ok),
        "net_revenue_uah": total(sum_where(ok, F.col("net_revenue_uah"))),
        "gross_profit_uah": total(sum_where(ok, F.col("gross_profit_uah"))),
        "discount_uah": total(sum_where(ok, discount)),
        "sales_before_discount_uah": total(sum_where(ok, before_discount)),
    }


def sale_ratios() -> dict[str, Column]:
    """Success rate, gross margin and discount rate as fractions of the measures."""
    return {
        "success_rate": safe_ratio(F.col("successful_orders"), F.col("created_orders")),
        "gross_margin": safe_ratio(F.col("gross_profit_uah"), F.col("net_revenue_uah")),
        "discount_rate": safe_ratio(F.col("discount_uah"), F.col("sales_before_discount_uah")),
    }


def _aggregate(grouped, measures: dict[str, Column]) -> DataFrame:
    return grouped.agg(*[c.alias(name) for name, c in measures.items()])


def yearly_totals(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Measures, distinct buyers and ratios per year over the comparison months."""
    in_period = month_in(F.col("order_month"), cfg.period_starts(*cfg.years))
    buyers = F.count_distinct(F.when(successful(), F.col("customer_id")))
    totals = _aggregate(
        mart.filter(in_period).groupBy("order_year"),
        {**sale_measures(), "active_customers": buyers},
    )
    return totals.withColumns(sale_ratios())


def monthly_totals(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Measures and ratios for every month of both years."""
    in_years = month_in(F.col("order_month"), cfg.year_starts(*cfg.years))
    totals = _aggregate(mart.filter(in_years).groupBy("order_month", "order_year"), sale_measures())
    return totals.withColumns(sale_ratios())


def kpi_comparison(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Executive KPIs per year with percent changes on the previous year."""
    # At most one row per compared year is left, so one partition is enough.
    by_year = Window.orderBy("order_year")

    def change(name: str) -> Column:
        return percent(change_on_previous_row(F.col(name), by_year))

    rates = yearly_totals(mart, cfg).select(
        "order_year",
        "created_orders",
        "successful_orders",
        "net_revenue_uah",
        "gross_profit_uah",
        "discount_uah",
        "sales_before_discount_uah",
        "active_customers",
        *[
            percent(F.col(name), digits=None).alias(f"{name}_percent")
            for name in ("success_rate", "gross_margin", "discount_rate")
        ],
    )
    margin_step = step_from_previous_row(F.col("gross_margin_percent"), by_year)
    return rates.select(
        "*",
        change("successful_orders").alias("orders_yoy_percent"),
        change("net_revenue_uah").alias("revenue_yoy_percent"),
        change("gross_profit_uah").alias("gross_profit_yoy_percent"),
        F.round(margin_step, 2).alias("gross_margin_change_pp"),
        change("active_customers").alias("active_customers_yoy_percent"),
    ).orderBy("order_year")


def kpi_summary(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Dashboard form of the yearly KPIs: ratios and changes as fractions."""
    by_year = Window.orderBy("order_year")

    def change(name: str) -> Column:
        return change_on_previous_row(F.col(name), by_year)

    totals = yearly_totals(mart, cfg)
    return totals.select(
        "order_year",
        "created_orders",
        "successful_orders",
        F.col("success_rate").alias("success_rate_percent"),
        "net_revenue_uah",
        "gross_profit_uah",
        F.col("gross_margin").alias("gross_margin_percent"),
        "active_customers",
        change("successful_orders").alias("orders_yoy_percent"),
        change("net_revenue_uah").alias("revenue_yoy_percent"),
        change("gross_profit_uah").alias("gross_profit_yoy_percent"),
        step_from_previous_row(F.col("gross_margin"), by_year).alias("gross_margin_change_pp"),
        step_from_previous_row(F.col("success_rate"), by_year).alias("success_rate_change_pp"),
        change("active_customers").alias("active_customers_yoy_percent"),
    ).orderBy("order_year")


def monthly_yoy(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Successful orders and gross profit per month beside the same month last year."""
    current, previous = cfg.current_year, cfg.previous_year
    paired = pair_months(
        monthly_totals(mart, cfg), ["successful_orders", "gross_profit_uah"], current, previous
    )
    orders, orders_before = F.col("successful_orders"), F.col("previous_successful_orders")
    profit, profit_before = F.col("gross_profit_uah"), F.col("previous_gross_profit_uah")
    return paired.select(
        "order_month",
        orders.alias(f"successful_orders_{current}"),
        orders_before.alias(f"successful_orders_{previous}"),
        percent(relative_change(orders, orders_before)).alias("orders_yoy_percent"),
        profit.alias(f"gross_profit_{current}_uah"),
        profit_before.alias(f"gross_profit_{previous}_uah"),
        percent(relative_change(profit, profit_before)).alias("gross_profit_yoy_percent"),
    ).orderBy("order_month")


def monthly_kpis(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Dashboard form: each month of the current year with its KPIs and growth."""
    shown = [
        "order_year",
        "created_orders",
        "successful_orders",
        "success_rate",
        "net_revenue_uah",
        "gross_profit_uah",
        "gross_margin",
        "discount_rate",
    ]
    paired = pair_months(monthly_totals(mart, cfg), shown, cfg.current_year, cfg.previous_year)

    def growth(name: str) -> Column:
        return relative_change(F.col(name), F.col(f"previous_{name}"))

    return paired.select(
        "order_month",
        "order_year",
        "created_orders",
        "successful_orders",
        F.col("success_rate").alias("success_rate_percent"),
        "net_revenue_uah",
        "gross_profit_uah",
        F.col("gross_margin").alias("gross_margin_percent"),
        F.col("discount_rate").alias("discount_rate_percent"),
        growth("successful_orders").alias("orders_yoy_percent"),
        growth("gross_profit_uah").alias("gross_profit_yoy_percent"),
    ).orderBy("order_month")


def customer_counts(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """New and returning buyers per year with their share as a fraction."""
    buyers = first_event_cohort(
        mart.filter(successful() & F.col("customer_id").isNotNull()),
        "customer_id",
        "order_date",
        "order_month",
        {year: cfg.period_starts(year) for year in cfg.years},
    ).withColumnRenamed("period", "order_year")
    period_start = F.make_date(F.col("order_year"), F.lit(cfg.first_period_month), F.lit(1))
    kind = F.when(F.col("first_day") >= period_start, "New").otherwise("Returning")
    counts = (
        buyers.withColumn("customer_type", kind)
        .groupBy("order_year", "customer_type")
        .agg(F.count("*").alias("customers"))
    )
    share = share_of_total(F.col("customers"), Window.partitionBy("order_year"))
    return counts.withColumn("share", share)


def customer_mix(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    return (
        customer_counts(mart, cfg)
        .withColumn("customer_share_percent", percent(F.col("share")))
        .drop("share")
        .orderBy("order_year", "customer_type")
    )


def customer_mix_summary(mart: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Dashboard form: the share as a fraction."""
    return (
        customer_counts(mart, cfg)
        .withColumnRenamed("share", "customer_share_percent")
        .orderBy("order_year", "customer_type")
    )
