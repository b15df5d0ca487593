"""Edge rows of the order facts and the mart."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from shopledger.config import AnalysisConfig
from shopledger.operators import order_facts
from shopledger.operators.order_mart import MART_COLUMNS, in_report_order, order_level_mart
from tests.tiny_shop import by_key, item, order, payment, returned, shop

CFG = AnalysisConfig()


@pytest.fixture(scope="module")
def mart(spark):
    tables = shop(
        spark,
        customers=[
            {"customer_id": 1, "acquisition_channel": "ads", "home_region": "Kyiv"},
            {"customer_id": 2},
        ],
        orders=[
            order(1),
            order(2, delivered_ts="2025-12-31 23:59:59"),
            order(3, delivered_ts="2026-01-01 00:00:00"),
            order(4, delivered_ts=None),
            order(5),
            order(6),
            order(7, customer_id=None, shipping_region=" odessa "),
            order(8, customer_id=555, shipping_region="Chernihiv"),
            order(9, customer_id=2, shipping_region=None),
            order(10, order_ts="2023-12-31 23:59:59"),
            order(11, order_ts="2025-12-31 23:59:59"),
            order(12, order_ts="2026-01-01 00:00:00"),
            order(13, order_status="shipped"),
            order(14),
            order(15),
            order(16),
            # A guest whose order id is the id of a customer.
            order(-1, customer_id=None),
        ],
        order_items=[
            item(100 + n, n, quantity=2, item_discount_uah=10) for n in range(1, 14) if n != 6
        ]
        + [item(114, 14), item(114, 14, unit_cost_uah=50), item(115, 15, unit_cost_uah=None)],
        payments=[
            payment(1, "captured", 190, 1),
            payment(1, "failed", 190, 2, "2026-01-01 00:00:00"),
            payment(2, "failed", 190, 1),
            payment(2, "captured", 190, 2),
            payment(3),
            payment(4),
            payment(5, "captured", 100, 1),
            payment(5, "refunded", 100, 2),
            payment(6, "captured", 500, 1),
            payment(6, "refunded", 100, 2),
            payment(8, "pending", 10, 1),
            payment(14, "captured", 200),
            payment(15, "captured", 100),
            payment(16, "chargeback", 40),
        ],
        returns=[
            returned(101, 1, "requested"),
            returned(101, 1, "rejected"),
            returned(101, 1, "completed", at="2026-01-01 00:00:00"),
            returned(999, 6, "completed", 1, 100),
            returned(114, 14, "completed", 1, 30),
            returned(115, 15, "completed", 1, 20),
            returned(None, 16, "approved"),
        ],
    )
    return by_key(order_level_mart(tables, CFG), "order_id")


def test_window_and_columns(mart):
    assert set(mart) == {*range(1, 10), 11, 13, 14, 15, 16, -1}
    assert tuple(mart[1]) == MART_COLUMNS
    assert len(MART_COLUMNS) == 60
    assert mart[11]["order_date"] == date(2025, 12, 31)
    assert mart[11]["order_month"] == date(2025, 12, 1)
    assert mart[11]["order_year"] == 2025


def test_delivered_by_cutoff(mart):
    flags = {n: mart[n]["is_delivered_by_cutoff"] for n in (1, 2, 3, 4, 13)}
    assert flags == {1: 1, 2: 1, 3: 0, 4: 0, 13: 0}


@pytest.mark.parametrize("order_id", [3, 4, 13])
def test_undelivered_orders_have_no_money(mart, order_id):
    for column in ("net_revenue_uah", "net_item_cost_uah", "net_sold_quantity", "gross_profit_uah"):
        assert mart[order_id][column] == 0
    assert mart[order_id]["is_fulfilled_and_captured"] == 0
    assert mart[order_id]["gross_margin_percent"] is None


def test_items_and_margin(mart):
    row = mart[1]
    assert row["has_order_items"] == 1
    assert (row["order_lines_count"], row["sold_quantity"]) == (1, 2)
    assert row["item_sales_before_returns_uah"] == 190
    assert row["item_gross_profit_before_returns_uah"] == 70
    assert row["net_revenue_uah"] == 190
    assert row["gross_profit_uah"] == 70
    assert row["gross_margin_percent"] == 36.84


def test_late_events_are_ignored(mart):
    row = mart[1]
    assert (row["payment_events_count"], row["failed_events"]) == (1, 0)
    assert row["latest_payment_status"] == "captured"
    assert (row["return_requests_count"], row["completed_returns"]) == (2, 0)
    assert (row["requested_returns"], row["rejected_returns"]) == (1, 1)
    assert row["returned_item_cost_uah"] == 0
    assert row["last_return_request_ts"] == datetime(2025, 10, 20, 9)


def test_latest_payment(mart):
    assert mart[2]["latest_payment_status"] == "captured"
    assert mart[5]["latest_payment_status"] == "refunded"
    assert mart[9]["latest_payment_status"] is None
    assert mart[9]["last_payment_ts"] is None


def test_full_reversal(mart):
    row = mart[5]
    assert row["net_revenue_uah"] == 0
    assert row["is_fulfilled_and_captured"] == 1
    assert row["is_retained_sale"] == 0
    assert row["is_fully_reversed_sale"] == 1
    assert row["gross_margin_percent"] is None


def test_refund_booked_twice_is_subtracted_twice(mart):
    row = mart[6]
    assert row["retained_payment_uah"] == 400
    assert row["completed_refund_uah"] == 100
    assert row["net_revenue_uah"] == 300


def test_return_of_unknown_item_has_no_cost(mart):
    row = mart[6]
    assert row["has_order_items"] == 0
    assert row["returned_quantity"] == 1
    assert row["returned_item_cost_uah"] == 0
    assert row["net_sold_quantity"] == -1


def test_return_of_repeated_item_counts_per_copy(mart):
    row = mart[14]
    assert row["return_requests_count"] == 2
    assert row["returned_quantity"] == 2
    assert row["completed_refund_uah"] == 60
    assert row["returned_item_cost_uah"] == 110


def test_item_without_cost(mart):
    row = mart[15]
    assert row["item_cost_before_returns_uah"] == 0
    assert row["item_gross_profit_before_returns_uah"] == 0
    assert row["item_sales_before_returns_uah"] == 100
    assert row["returned_item_cost_uah"] == 0


def test_chargeback_without_capture(mart):
    row = mart[16]
    assert row["retained_payment_uah"] == Decimal(-40)
    assert row["is_fulfilled_and_captured"] == 0
    assert row["is_fully_reversed_sale"] == 0
    assert row["approved_returns"] == 1


def test_labels(mart):
    assert [mart[n]["acquisition_channel"] for n in (1, 7, 8, 9, -1)] == [
        "ads",
        "Guest checkout",
        "Unknown acquisition channel",
        "Unknown acquisition channel",
        "Guest checkout",
    ]
    assert [mart[n]["is_guest_checkout"] for n in (1, 7, 8)] == [0, 1, 0]
    assert mart[-1]["customer_home_region"] is None
    assert [mart[n]["normalized_shipping_region"] for n in (1, 7, 8, 9)] == [
        "Lviv",
        "Odesa",
        "Chernihiv",
        None,
    ]


def test_guest_order_numbered_like_a_customer_stays_a_guest(spark):
    tables = shop(
        spark,
        customers=[{"customer_id": 5, "acquisition_channel": "ads"}],
        orders=[order(5, customer_id=None), order(6, customer_id=5)],
    )
    rows = by_key(order_level_mart(tables, CFG), "order_id")
    assert rows[5]["acquisition_channel"] == "Guest checkout"
    assert rows[6]["acquisition_channel"] == "ads"


def test_repeated_customer_rows_repeat_the_order(spark):
    tables = shop(
        spark,
        customers=[{"customer_id": 1}, {"customer_id": 1}],
        orders=[order(1)],
        payments=[payment(1)],
    )
    assert order_level_mart(tables, CFG).count() == 2


def test_report_order(spark):
    tables = shop(
        spark,
        orders=[
            order(3),
            order(1),
            order(2, order_ts="2025-01-01 00:00:00"),
        ],
    )
    ordered = in_report_order(order_level_mart(tables, CFG)).collect()
    assert [row.order_id for row in ordered] == [2, 1, 3]


def test_returns_facts_keep_unknown_cost_unknown(spark):
    tables = shop(
        spark,
        order_items=[item(1, 1), item(2, 2, unit_cost_uah=None)],
        returns=[
            returned(99, 10),
            returned(99, 11),
            returned(99, 11, "approved"),
            returned(2, 12),
            returned(1, 13, pieces=None),
            returned(1, 14, pieces=None),
            returned(1, 14, pieces=3),
            returned(None, 15, "requested"),
            returned(1, None),
        ],
    )
    facts = by_key(
        order_facts.returns_by_order(tables.returns, tables.order_items, CFG), "order_id"
    )
    cost = {n: facts[n]["returned_item_cost_uah"] for n in facts}
    assert cost == {10: None, 11: 0, 12: None, 13: None, 14: 180, 15: 0, None: 60}
    assert facts[13]["returned_quantity"] is None
    assert facts[14]["returned_quantity"] == 3
