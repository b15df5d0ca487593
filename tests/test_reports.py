"""Edge cases of the reports over hand-made marts."""

from datetime import date
from decimal import Decimal

import pytest

from shopledger.config import AnalysisConfig
from shopledger.operators import drivers, kpis, targets
from tests.tiny_shop import by_key, item, returned, sale, table, tiny_mart

CFG = AnalysisConfig()


def test_kpis_count_only_the_comparison_months(spark):
    mart = tiny_mart(
        spark,
        sale(1, "2024-10-01"),
        sale(2, "2024-11-30", customer=2, ok=0),
        sale(3, "2024-12-01"),
        sale(4, "2025-10-15"),
        sale(5, "2025-11-15", customer=2, profit=20),
        sale(6, "2025-11-16", customer=None, profit=0),
        sale(7, "2025-09-30"),
    )
    rows = by_key(kpis.kpi_comparison(mart, CFG), "order_year")
    before, now = rows[2024], rows[2025]
    assert (before["created_orders"], before["successful_orders"]) == (2, 1)
    assert (before["success_rate_percent"], before["discount_rate_percent"]) == (50.0, 10.0)
    assert before["orders_yoy_percent"] is None
    assert (now["successful_orders"], now["active_customers"]) == (3, 2)
    assert now["orders_yoy_percent"] == 200.0
    assert now["gross_profit_yoy_percent"] == 50.0
    assert now["gross_margin_change_pp"] == -20.0
    summary = by_key(kpis.kpi_summary(mart, CFG), "order_year")
    assert summary[2025]["orders_yoy_percent"] == 2.0
    assert summary[2025]["success_rate_change_pp"] == 0.5


def test_kpis_with_nothing_to_compare_to(spark):
    mart = tiny_mart(spark, sale(1, "2024-10-01", ok=0), sale(2, "2025-10-01"))
    rows = by_key(kpis.kpi_comparison(mart, CFG), "order_year")
    assert rows[2024]["gross_margin_percent"] is None
    assert rows[2025]["orders_yoy_percent"] is None
    assert rows[2025]["gross_margin_change_pp"] is None
    alone = kpis.kpi_comparison(mart.filter("order_year = 2025"), CFG).collect()
    assert [row.revenue_yoy_percent for row in alone] == [None]


def test_monthly_pairs(spark):
    mart = tiny_mart(
        spark,
        sale(1, "2024-02-29"),
        sale(2, "2025-02-01", profit=60),
        sale(3, "2025-03-01"),
        sale(4, "2024-04-01"),
        sale(5, "2024-12-01", ok=0),
        sale(6, "2025-12-31"),
    )
    rows = kpis.monthly_yoy(mart, CFG).collect()
    assert [row.order_month for row in rows] == [
        date(2025, 2, 1),
        date(2025, 3, 1),
        date(2025, 12, 1),
    ]
    assert [row.successful_orders_2024 for row in rows] == [1, None, 0]
    assert [row.orders_yoy_percent for row in rows] == [0.0, None, None]
    assert [row.gross_profit_yoy_percent for row in rows] == [50.0, None, None]
    exported = kpis.monthly_kpis(mart, CFG).collect()
    assert [row.gross_profit_yoy_percent for row in exported] == [0.5, None, None]
    assert [row.order_year for row in exported] == [2025, 2025, 2025]


def test_new_and_returning_customers(spark):
    mart = tiny_mart(
        spark,
        sale(1, "2025-09-30", customer=1),
        sale(2, "2025-10-01", customer=1),
        sale(3, "2025-10-01", customer=2),
        sale(4, "2025-11-30", customer=2),
        sale(5, "2024-10-02", customer=3),
        sale(6, "2025-11-02", customer=3),
        sale(7, "2025-08-01", customer=4, ok=0),
        sale(8, "2025-10-08", customer=4),
        sale(9, "2025-10-09", customer=None),
        sale(10, "2025-12-01", customer=5),
    )
    rows = [tuple(row) for row in kpis.customer_mix(mart, CFG).collect()]
    assert rows == [
        (2024, "New", 1, 100.0),
        (2025, "New", 2, 50.0),
        (2025, "Returning", 2, 50.0),
    ]
    shares = [row.customer_share_percent for row in kpis.customer_mix_summary(mart, CFG).collect()]
    assert shares == [1.0, 0.5, 0.5]


def test_discount_scenario(spark):
    mart = tiny_mart(
        spark,
        sale(1, "2024-10-01"),
        sale(2, "2025-10-01"),
        sale(3, "2025-10-01", ok=0),
        sale(4, "2025-12-01"),
    )
    items = table(
        spark,
        "order_items",
        [
            item(1, 1, item_discount_uah=5),
            item(2, 2, quantity=3, item_discount_uah=30),
            item(3, 2, item_discount_uah=None),
            item(4, 3, item_discount_uah=50),
            item(5, 4, item_discount_uah=50),
        ],
    )
    row = drivers.discount_scenario(mart, items, CFG).first()
    assert tuple(row) == (Decimal(400), 5.0, 7.5, Decimal(30), 20.0, 10.0)
    one_year = mart.filter("order_year = 2025")
    assert drivers.discount_scenario(one_year, items, CFG).count() == 0


@pytest.fixture(scope="module")
def category_totals(spark):
    mart = tiny_mart(
        spark, sale(1, "2024-10-01"), sale(2, "2025-10-01"), sale(3, "2025-10-01", ok=0)
    )
    items = table(
        spark,
        "order_items",
        [
            item(1, 1, product_id=1),
            item(2, 2, product_id=1, quantity=2),
            item(3, 2, product_id=2, item_discount_uah=10),
            item(4, 1, product_id=3),
            item(5, 3, product_id=1),
            item(6, 2, product_id=99),
            item(7, 2, product_id=2, unit_cost_uah=None),
        ],
    )
    products = table(
        spark,
        "products",
        [
            {"product_id": 1, "category": "Toys"},
            {"product_id": 2, "category": "Books"},
            {"product_id": 3, "category": "Music"},
        ],
    )
    returns = table(
        spark,
        "returns",
        [
            returned(2, 2, pieces=1, refund=100),
            returned(2, 2, "approved", pieces=1, refund=100),
            returned(3, 2, at="2026-01-01 00:00:00"),
        ],
    )
    return drivers.category_totals(mart, items, products, returns, CFG)


def test_category_profit_change(category_totals):
    rows = by_key(drivers.category_profit_change(category_totals, CFG), "category")
    assert tuple(rows["Toys"].values()) == ("Toys", 40, 40, 0, "Growth")
    # The line without a cost adds nothing here.
    assert tuple(rows["Books"].values()) == ("Books", None, 30, None, "Decline")
    assert tuple(rows["Music"].values()) == ("Music", 40, None, None, "Decline")
    assert list(rows)[0] == "Toys"


def test_category_summary(category_totals):
    rows = by_key(drivers.category_summary(category_totals, CFG), "category")
    # Here it keeps its sales and only lacks the cost.
    assert rows["Books"]["gross_profit_2025_uah"] == 130
    assert rows["Books"]["discount_rate_2025_percent"] == 0.05
    assert rows["Books"]["discount_rate_2024_percent"] is None
    assert rows["Books"]["category_result"] == "Decline"
    assert rows["Toys"]["gross_margin_2025_percent"] == 0.4
    assert rows["Toys"]["category_result"] == "Growth"


def test_regions_against_targets(spark):
    mart = tiny_mart(
        spark,
        sale(1, "2025-10-01", profit=60),
        sale(2, "2025-11-01", ok=0, profit=-10),
        sale(3, "2025-12-01", profit=900),
        sale(4, "2024-10-01", profit=900),
        sale(5, "2025-10-01", region=None),
        sale(6, "2025-10-01", region="Odesa", profit=49),
    )
    goals = [("Lviv", 1, 25), ("Sumy", 1, 25), ("Odesa", 1, 25)]
    monthly = table(
        spark,
        "monthly_targets",
        [
            {
                "month": month,
                "region": region,
                "orders_target": orders,
                "gross_profit_target_uah": profit,
            }
            for month in ("2025-9", "2025-10", "2025-11", "2025-12")
            for region, orders, profit in goals
        ],
    )
    rows = by_key(targets.region_targets(mart, monthly, CFG), "region")
    assert set(rows) == {"Lviv", "Sumy", "Odesa"}
    assert tuple(rows["Lviv"].values()) == ("Lviv", 2, 2, 100.0, 50, 50, 100.0)
    assert tuple(rows["Sumy"].values()) == ("Sumy", None, 2, None, None, 50, None)
    assert list(rows)[-1] == "Sumy"
    summary = by_key(targets.region_summary(mart, monthly, CFG), "region")
    assert summary["Lviv"]["target_status"] == "Both met"
    assert summary["Lviv"]["successful_orders"] == 1
    assert summary["Sumy"]["target_status"] == "Both missed"
    assert summary["Sumy"]["orders_actual"] == 0
    assert summary["Sumy"]["gross_profit_target_attainment_percent"] == 0.0
    assert summary["Odesa"]["target_status"] == "Both missed"


def test_column_names_follow_the_compared_years(spark):
    mart = tiny_mart(spark, sale(1, "2023-05-01"), sale(2, "2024-05-01"))
    cfg = AnalysisConfig(previous_year=2023, current_year=2024, period_months=(5,))
    report = kpis.monthly_yoy(mart, cfg)
    assert "successful_orders_2024" in report.columns
    assert report.first().successful_orders_2023 == 1
