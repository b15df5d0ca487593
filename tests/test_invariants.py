"""Relations that hold between results, on the whole sample shop."""

import pytest
from pyspark.sql import functions as F

from shopledger.config import AnalysisConfig
from shopledger.operators import drivers, kpis, targets
from shopledger.operators.order_mart import order_level_mart, orders_in_window
from shopledger.sources.sample_shop import sample_tables
from tests.tiny_shop import by_key

CFG = AnalysisConfig()


@pytest.fixture(scope="module")
def shop_tables(spark):
    return sample_tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def mart(shop_tables):
    stored = order_level_mart(shop_tables, CFG).persist()
    yield stored
    stored.unpersist()


def test_one_row_per_order(shop_tables, mart):
    assert mart.count() == orders_in_window(shop_tables.orders, CFG).count()
    assert mart.select("order_id").distinct().count() == mart.count()


@pytest.mark.parametrize(
    "broken",
    [
        "is_fulfilled_and_captured = 1 "
        "AND (net_revenue_uah > 0) = (is_fully_reversed_sale = 1)",
        "(gross_margin_percent IS NULL) != (net_revenue_uah <= 0)",
        "is_delivered_by_cutoff = 0 AND (net_revenue_uah != 0 OR net_item_cost_uah != 0 "
        "OR net_sold_quantity != 0 OR gross_profit_uah != 0)",
        "captured_events + failed_events + pending_events + refunded_events "
        "+ chargeback_events != payment_events_count",
        "requested_returns + approved_returns + completed_returns + rejected_returns "
        "!= return_requests_count",
        "captured_amount_uah - payment_refunded_uah - chargeback_uah != retained_payment_uah",
        "item_sales_before_returns_uah - item_cost_before_returns_uah "
        "!= item_gross_profit_before_returns_uah",
        "has_order_items != if(order_lines_count > 0, 1, 0)",
    ],
)
def test_no_row_breaks(mart, broken):
    assert mart.filter(broken).count() == 0


def test_shares_sum_to_one(mart):
    sums = kpis.customer_mix_summary(mart, CFG).groupBy("order_year")
    for row in sums.agg(F.sum("customer_share_percent").alias("s")).collect():
        assert row.s == pytest.approx(1.0)


def test_percent_reports_agree_with_extracts(mart):
    report = by_key(kpis.kpi_comparison(mart, CFG), "order_year")
    extract = by_key(kpis.kpi_summary(mart, CFG), "order_year")
    assert report.keys() == extract.keys()
    for year, row in report.items():
        for ratio in ("success_rate_percent", "gross_margin_percent"):
            assert row[ratio] == pytest.approx(100 * extract[year][ratio])


def test_region_reports_agree(shop_tables, mart):
    goals = shop_tables.monthly_targets
    report = by_key(targets.region_targets(mart, goals, CFG), "region")
    extract = by_key(targets.region_summary(mart, goals, CFG), "region")
    assert report.keys() == extract.keys()
    for region, row in report.items():
        assert extract[region]["orders_actual"] == (row["orders_actual"] or 0)
        assert extract[region]["gross_profit_actual_uah"] == (row["gross_profit_actual_uah"] or 0)


def test_category_reports_agree(shop_tables, mart):
    t = shop_tables
    totals = drivers.category_totals(mart, t.order_items, t.products, t.returns, CFG)
    report = by_key(drivers.category_profit_change(totals, CFG), "category")
    extract = by_key(drivers.category_summary(totals, CFG), "category")
    for category, row in report.items():
        for year in CFG.years:
            name = f"gross_profit_{year}_uah"
            assert row[name] == extract[category][name]


def test_discount_rates_of_mart_and_items_agree(shop_tables, mart):
    from_mart = by_key(kpis.kpi_comparison(mart, CFG), "order_year")
    from_items = drivers.discount_scenario(mart, shop_tables.order_items, CFG).first()
    for year in CFG.years:
        assert from_items[f"discount_rate_{year}_percent"] == pytest.approx(
            from_mart[year]["discount_rate_percent"], abs=0.005
        )
