"""DuckDB CTEs of the order mart."""

from oracle.shop import SHOP, _quoted

# Cleaned spelling of a region -> its name.
REGION_NAMES = {
    "dnipropetrovsk": "Dnipropetrovsk",
    "dnipropetrovska": "Dnipropetrovsk",
    "ivano frankivsk": "Ivano-Frankivsk",
    "kharkiv": "Kharkiv",
    "kyiv": "Kyiv",
    "kyiv city": "Kyiv City",
    "lviv": "Lviv",
    "odesa": "Odesa",
    "odessa": "Odesa",
    "poltava": "Poltava",
    "vinnytsia": "Vinnytsia",
    "zaporizhia": "Zaporizhzhia",
    "zaporizhzhia": "Zaporizhzhia",
}

_names = ", ".join(f"({_quoted(raw)}, {_quoted(name)})" for raw, name in REGION_NAMES.items())

# Every amount of the mart is compared as DOUBLE; the sums behind it are exact.
MART = {
    "item_facts": """
    SELECT order_id,
           count(*) AS order_lines_count,
           count(DISTINCT product_id) AS distinct_products_count,
           CAST(sum(quantity) AS BIGINT) AS sold_quantity,
           sum(item_discount_uah) AS item_discount_uah,
           sum(quantity * unit_price_uah - item_discount_uah) AS item_sales_before_returns_uah,
           sum(quantity * unit_cost_uah) AS item_cost_before_returns_uah,
           sum(quantity * (unit_price_uah - unit_cost_uah) - item_discount_uah)
             AS item_gross_profit_before_returns_uah
    FROM f_order_items GROUP BY ALL""",
    "payment_facts": """
    SELECT order_id,
           count(*) AS payment_events_count,
           count(*) FILTER (payment_status = 'captured') AS captured_events,
           count(*) FILTER (payment_status = 'failed') AS failed_events,
           count(*) FILTER (payment_status = 'pending') AS pending_events,
           count(*) FILTER (payment_status = 'refunded') AS refunded_events,
           count(*) FILTER (payment_status = 'chargeback') AS chargeback_events,
           coalesce(sum(payment_amount_uah) FILTER (payment_status = 'captured'), 0)
             AS captured_amount_uah,
           coalesce(sum(payment_amount_uah) FILTER (payment_status = 'refunded'), 0)
             AS payment_refunded_uah,
           coalesce(sum(payment_amount_uah) FILTER (payment_status = 'chargeback'), 0)
             AS chargeback_uah,
           captured_amount_uah - payment_refunded_uah - chargeback_uah AS retained_payment_uah,
           last(payment_status ORDER BY payment_sequence, payment_ts, payment_status)
             AS latest_payment_status,
           max(payment_ts) AS last_payment_ts
    FROM f_payments WHERE payment_ts < TIMESTAMP '2026-01-01' GROUP BY ALL""",
    "return_rows": """
    SELECT r.*, i.unit_cost_uah, r.return_status = 'completed' AS done
    FROM f_returns r LEFT JOIN f_order_items i USING (order_item_id)
    WHERE r.return_request_ts < TIMESTAMP '2026-01-01'""",
    "return_facts": """
    SELECT order_id,
           count(*) AS return_requests_count,
           count(*) FILTER (return_status = 'requested') AS requested_returns,
           count(*) FILTER (return_status = 'approved') AS approved_returns,
           count(*) FILTER (done) AS completed_returns,
           count(*) FILTER (return_status = 'rejected') AS rejected_returns,
           CAST(coalesce(sum(returned_quantity) FILTER (done), 0) AS BIGINT) AS returned_quantity,
           coalesce(sum(refund_amount_uah) FILTER (done), 0) AS completed_refund_uah,
           sum(CASE WHEN NOT done THEN 0 ELSE returned_quantity * unit_cost_uah END)
             AS returned_item_cost_uah,
           max(return_request_ts) AS last_return_request_ts
    FROM return_rows GROUP BY ALL""",
    "region_names": f"""
    SELECT * FROM (VALUES {_names}) AS n(cleaned, name)""",
    "window_orders": """
    SELECT *, CAST(order_ts AS DATE) AS order_date,
           CAST(date_trunc('month', order_ts) AS DATE) AS order_month,
           CAST(year(order_ts) AS INTEGER) AS order_year,
           lower(trim(regexp_replace(shipping_region, '[-\\s]+', ' ', 'g'))) AS cleaned,
           CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END AS is_guest_checkout,
           CASE WHEN order_status = 'delivered' AND delivered_ts < TIMESTAMP '2026-01-01'
                THEN 1 ELSE 0 END AS is_delivered_by_cutoff
    FROM f_orders
    WHERE order_ts >= TIMESTAMP '2024-01-01' AND order_ts < TIMESTAMP '2026-01-01'""",
    "base": """
    SELECT o.order_id, o.customer_id, o.order_ts, o.order_date, o.order_month, o.order_year,
           o.order_status, o.order_channel, o.device_type, o.shipping_region,
           coalesce(n.name, o.shipping_region) AS normalized_shipping_region,
           o.shipping_city, o.shipping_fee_uah, o.promised_delivery_ts, o.delivered_ts,
           o.is_guest_checkout,
           CASE o.is_guest_checkout WHEN 1 THEN 'Guest checkout'
                ELSE coalesce(c.acquisition_channel, 'Unknown acquisition channel') END
             AS acquisition_channel,
           c.loyalty_tier, c.home_region AS customer_home_region,
           c.home_city AS customer_home_city, c.birth_year, c.signup_ts,
           o.is_delivered_by_cutoff,
           CASE WHEN i.order_lines_count > 0 THEN 1 ELSE 0 END AS has_order_items,
           {zero_filled_items},
           {zero_filled_payments},
           p.latest_payment_status, p.last_payment_ts,
           {zero_filled_returns},
           r.last_return_request_ts
    FROM window_orders o
    LEFT JOIN region_names n USING (cleaned)
    LEFT JOIN f_customers c ON c.customer_id = o.customer_id
    LEFT JOIN item_facts i ON i.order_id = o.order_id
    LEFT JOIN payment_facts p ON p.order_id = o.order_id
    LEFT JOIN return_facts r ON r.order_id = o.order_id""",
    "financials": """
    SELECT *,
           is_delivered_by_cutoff * (retained_payment_uah - completed_refund_uah)
             AS net_revenue_uah,
           is_delivered_by_cutoff * (item_cost_before_returns_uah - returned_item_cost_uah)
             AS net_item_cost_uah,
           is_delivered_by_cutoff * (sold_quantity - returned_quantity) AS net_sold_quantity
    FROM base""",
    "metrics": """
    SELECT *, net_revenue_uah - net_item_cost_uah AS gross_profit_uah,
           is_delivered_by_cutoff * CAST(captured_events > 0 AS INTEGER)
             AS is_fulfilled_and_captured,
           is_delivered_by_cutoff * CAST(net_revenue_uah > 0 AS INTEGER) AS is_retained_sale,
           is_delivered_by_cutoff * CAST(captured_events > 0 AS INTEGER)
             * CAST(net_revenue_uah <= 0 AS INTEGER) AS is_fully_reversed_sale
    FROM financials""",
    "mart": """
    SELECT *, CASE WHEN net_revenue_uah > 0
                   THEN round(100 * (CAST(gross_profit_uah AS DOUBLE)
                                     / CAST(net_revenue_uah AS DOUBLE)), 2)
              END AS gross_margin_percent
    FROM metrics""",
}

ITEM_COUNTS = ("order_lines_count", "distinct_products_count", "sold_quantity")
ITEM_AMOUNTS = (
    "item_discount_uah",
    "item_sales_before_returns_uah",
    "item_cost_before_returns_uah",
    "item_gross_profit_before_returns_uah",
)
PAYMENT_COUNTS = (
    "payment_events_count",
    "captured_events",
    "failed_events",
    "pending_events",
    "refunded_events",
    "chargeback_events",
)
PAYMENT_AMOUNTS = (
    "captured_amount_uah",
    "payment_refunded_uah",
    "chargeback_uah",
    "retained_payment_uah",
)
RETURN_COUNTS = (
    "return_requests_count",
    "requested_returns",
    "approved_returns",
    "completed_returns",
    "rejected_returns",
    "returned_quantity",
)
RETURN_AMOUNTS = ("completed_refund_uah", "returned_item_cost_uah")


def _zero_filled(alias: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"coalesce({alias}.{n}, 0) AS {n}" for n in names)


MART["base"] = MART["base"].format(
    zero_filled_items=_zero_filled("i", ITEM_COUNTS + ITEM_AMOUNTS),
    zero_filled_payments=_zero_filled("p", PAYMENT_COUNTS + PAYMENT_AMOUNTS),
    zero_filled_returns=_zero_filled("r", RETURN_COUNTS + RETURN_AMOUNTS),
)

CTES = {**SHOP, **MART}
