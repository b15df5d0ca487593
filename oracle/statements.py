"""One DuckDB statement per registered query."""

import re

from oracle.mart import (
    CTES,
    ITEM_AMOUNTS,
    ITEM_COUNTS,
    PAYMENT_AMOUNTS,
    PAYMENT_COUNTS,
    RETURN_AMOUNTS,
    RETURN_COUNTS,
)

# The mart's columns in order.
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
    "order_lines_count",
    "distinct_products_count",
    "sold_quantity",
    "item_discount_uah",
    "item_sales_before_returns_uah",
    "item_cost_before_returns_uah",
    "item_gross_profit_before_returns_uah",
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
    "latest_payment_status",
    "last_payment_ts",
    "return_requests_count",
    "requested_returns",
    "approved_returns",
    "completed_returns",
    "rejected_returns",
    "returned_quantity",
    "completed_refund_uah",
    "returned_item_cost_uah",
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

PERIOD = "month(order_date) IN (10, 11)"
SOLD = "is_fulfilled_and_captured = 1"

# CTEs of the analyses, on top of the mart.
ANALYSIS = {
    "sales": f"""
    SELECT *, {SOLD} AS sold,
           item_sales_before_returns_uah + item_discount_uah AS full_value
    FROM mart""",
    "yearly": f"""
    SELECT order_year, count(*) AS created, count(*) FILTER (sold) AS successful,
           coalesce(sum(net_revenue_uah) FILTER (sold), 0) AS revenue,
           coalesce(sum(gross_profit_uah) FILTER (sold), 0) AS profit,
           coalesce(sum(item_discount_uah) FILTER (sold), 0) AS discount,
           coalesce(sum(full_value) FILTER (sold), 0) AS full_value,
           count(DISTINCT customer_id) FILTER (sold) AS buyers
    FROM sales WHERE order_year BETWEEN 2024 AND 2025 AND {PERIOD} GROUP BY ALL""",
    "monthly": """
    SELECT order_month, order_year, count(*) AS created, count(*) FILTER (sold) AS successful,
           coalesce(sum(net_revenue_uah) FILTER (sold), 0) AS revenue,
           coalesce(sum(gross_profit_uah) FILTER (sold), 0) AS profit,
           coalesce(sum(item_discount_uah) FILTER (sold), 0) AS discount,
           coalesce(sum(full_value) FILTER (sold), 0) AS full_value
    FROM sales WHERE order_year BETWEEN 2024 AND 2025 GROUP BY ALL""",
    "monthly_lagged": """
    SELECT *, lag(successful) OVER same_month AS successful_before,
           lag(profit) OVER same_month AS profit_before
    FROM monthly
    WINDOW same_month AS (PARTITION BY month(order_month) ORDER BY order_year)""",
    "buyer_rows": """
    SELECT customer_id, order_date, order_year,
           min(order_date) OVER (PARTITION BY customer_id) AS first_date
    FROM sales WHERE sold AND customer_id IS NOT NULL""",
    "mix": f"""
    SELECT order_year,
           CASE WHEN year(first_date) = order_year AND month(first_date) >= 10 THEN 'New'
                ELSE 'Returning' END AS customer_type,
           count(DISTINCT customer_id) AS customers
    FROM buyer_rows WHERE order_year BETWEEN 2024 AND 2025 AND {PERIOD} GROUP BY ALL""",
    "period_items": f"""
    SELECT i.*, s.order_year
    FROM f_order_items i JOIN (SELECT order_id, order_year FROM sales WHERE sold AND {PERIOD}) s
      ON s.order_id = i.order_id""",
    "rates": """
    SELECT sum(quantity * unit_price_uah) FILTER (order_year = 2025) AS value_now,
           sum(item_discount_uah) FILTER (order_year = 2025) AS discount_now,
           sum(quantity * unit_price_uah) FILTER (order_year = 2024) AS value_before,
           sum(item_discount_uah) FILTER (order_year = 2024) AS discount_before,
           count(DISTINCT order_year) AS years
    FROM period_items""",
    "given_back": """
    SELECT order_item_id, sum(returned_quantity) AS pieces, sum(refund_amount_uah) AS refund
    FROM f_returns
    WHERE return_status = 'completed' AND return_request_ts < TIMESTAMP '2026-01-01'
    GROUP BY ALL""",
    "category_rows": """
    SELECT category, order_year, quantity * unit_price_uah AS full_value,
           item_discount_uah AS discount,
           quantity * unit_price_uah - item_discount_uah - coalesce(refund, 0) AS net_value,
           unit_cost_uah * (quantity - coalesce(pieces, 0)) AS net_cost
    FROM period_items JOIN f_products USING (product_id)
    LEFT JOIN given_back USING (order_item_id)""",
    "category_years": """
    SELECT category,
           sum(net_value - net_cost) FILTER (order_year = 2024) AS profit_before,
           sum(net_value - net_cost) FILTER (order_year = 2025) AS profit_now,
           sum(net_value) FILTER (order_year = 2025) AS net_now,
           sum(full_value) FILTER (order_year = 2024) AS value_before,
           sum(full_value) FILTER (order_year = 2025) AS value_now,
           sum(discount) FILTER (order_year = 2024) AS discount_before,
           sum(discount) FILTER (order_year = 2025) AS discount_now
    FROM category_rows GROUP BY ALL""",
    "regions": f"""
    SELECT t.region, a.orders, a.successful, a.profit, t.orders_goal, t.profit_goal
    FROM (SELECT region, CAST(sum(orders_target) AS BIGINT) AS orders_goal,
                 sum(gross_profit_target_uah) AS profit_goal
          FROM f_monthly_targets WHERE month IN ('2025-10', '2025-11') GROUP BY ALL) t
    LEFT JOIN (SELECT normalized_shipping_region AS region, count(*) AS orders,
                      count(*) FILTER (sold) AS successful, sum(gross_profit_uah) AS profit
               FROM sales WHERE order_year = 2025 AND {PERIOD} GROUP BY ALL) a
      ON a.region = t.region""",
}

ALL_CTES = {**CTES, **ANALYSIS}


def _needed(text: str) -> list[str]:
    """CTEs a statement uses, each after the ones it uses itself."""
    found: list[str] = []

    def visit(fragment: str) -> None:
        for name in ALL_CTES:
            if name not in found and re.search(rf"\b{name}\b(?=[^']*(?:'[^']*'[^']*)*$)", fragment):
                visit(ALL_CTES[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def statement(select: str) -> str:
    ctes = ",\n".join(f"{name} AS ({ALL_CTES[name]})" for name in _needed(select))
    return f"WITH {ctes}\n{select}" if ctes else select


def amount(expression: str, alias: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {alias}"


def ratio(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0))"


def percent(part: str, whole: str) -> str:
    return f"round(100 * {ratio(part, whole)}, 2)"


def amounts(names: tuple[str, ...]) -> str:
    return ", ".join(amount(n, n) for n in names)


def _mart_columns(columns: tuple[str, ...]) -> str:
    return ", ".join(amount(c, c) if c.endswith("_uah") else c for c in columns)


def _union(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


_TABLES = (
    "orders",
    "order_items",
    "customers",
    "products",
    "payments",
    "returns",
    "monthly_targets",
)


def _duplicates(label: str, table: str, key: str) -> str:
    distinct = f"(SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL)"
    return (
        f"SELECT '{label}' AS checked_key, (SELECT count(*) FROM {table})"
        f" - (SELECT count(*) FROM {distinct}) AS duplicate_rows"
    )


def _orphans(label: str, child: str, child_key: str, parent: str, key: str, extra: str = "") -> str:
    return (
        f"SELECT '{label}' AS relationship, count(*) AS orphan_rows FROM {child} ch"
        f" WHERE NOT EXISTS (SELECT 1 FROM {parent} pa WHERE pa.{key} = ch.{child_key}){extra}"
    )


_YEAR_PAIR = "FROM yearly c LEFT JOIN yearly p ON p.order_year = c.order_year - 1"


def _margin(side: str) -> str:
    return ratio(f"{side}.profit", f"{side}.revenue")


def _success(side: str) -> str:
    return ratio(f"{side}.successful", f"{side}.created")


STATEMENTS = {
    "dq_row_counts": _union(
        *[
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM f_{name}"
            for name in _TABLES
        ]
    ),
    "dq_duplicate_keys": _union(
        _duplicates("orders.order_id", "f_orders", "order_id"),
        _duplicates("order_items.order_item_id", "f_order_items", "order_item_id"),
        _duplicates("customers.customer_id", "f_customers", "customer_id"),
        _duplicates("products.product_id", "f_products", "product_id"),
    ),
    "dq_orphans": _union(
        _orphans(
            "orders -> customers",
            "f_orders",
            "customer_id",
            "f_customers",
            "customer_id",
            " AND ch.customer_id IS NOT NULL",
        ),
        _orphans("order_items -> orders", "f_order_items", "order_id", "f_orders", "order_id"),
        _orphans(
            "order_items -> products", "f_order_items", "product_id", "f_products", "product_id"
        ),
        _orphans("payments -> orders", "f_payments", "order_id", "f_orders", "order_id"),
        _orphans(
            "returns -> order_items",
            "f_returns",
            "order_item_id",
            "f_order_items",
            "order_item_id",
        ),
    ),
    "dq_null_status_profile": """
        SELECT total AS total_orders, guests AS missing_customer_id,
               round(100 * (CAST(guests AS DOUBLE) / nullif(total, 0)), 2)
                 AS missing_customer_percent,
               total - timed AS missing_delivered_ts, untimed AS delivered_without_timestamp
        FROM (SELECT count(*) AS total, count(*) - count(customer_id) AS guests,
                     count(delivered_ts) AS timed,
                     count(*) FILTER (order_status = 'delivered' AND delivered_ts IS NULL)
                       AS untimed
              FROM f_orders)""",
    "dq_invalid_items": """
        SELECT count(*) AS total_order_items,
               count(*) FILTER (quantity <= 0) AS invalid_quantity,
               count(*) FILTER (unit_price_uah < 0) AS negative_price,
               count(*) FILTER (unit_cost_uah < 0) AS negative_cost,
               count(*) FILTER (item_discount_uah < 0) AS negative_discount,
               count(*) FILTER (quantity * unit_price_uah < item_discount_uah)
                 AS discount_above_item_value
        FROM f_order_items""",
    "items_by_order": f"""
        SELECT order_id, {", ".join(ITEM_COUNTS)}, {amounts(ITEM_AMOUNTS)} FROM item_facts""",
    "payments_by_order": f"""
        SELECT order_id, {", ".join(PAYMENT_COUNTS)}, {amounts(PAYMENT_AMOUNTS)},
               latest_payment_status, last_payment_ts
        FROM payment_facts""",
    "returns_by_order": f"""
        SELECT order_id, {", ".join(RETURN_COUNTS)}, {amounts(RETURN_AMOUNTS)},
               last_return_request_ts
        FROM return_facts""",
    "order_base": f"SELECT {_mart_columns(BASE_COLUMNS)} FROM base",
    "normalize_region": """
        SELECT order_id, shipping_region, normalized_shipping_region
        FROM (SELECT o.*, coalesce(n.name, o.shipping_region) AS normalized_shipping_region
              FROM window_orders o LEFT JOIN region_names n USING (cleaned))""",
    "order_calendar": """
        SELECT order_id, order_date, order_month, order_year FROM window_orders""",
    "guest_flag": "SELECT order_id, customer_id, is_guest_checkout FROM window_orders",
    "acquisition_label": """
        SELECT o.order_id,
               CASE WHEN o.customer_id IS NULL THEN 'Guest checkout'
                    WHEN c.acquisition_channel IS NOT NULL THEN c.acquisition_channel
                    ELSE 'Unknown acquisition channel' END AS acquisition_channel
        FROM window_orders o LEFT JOIN f_customers c USING (customer_id)""",
    "delivered_by_cutoff_flag": """
        SELECT order_id, order_status, delivered_ts, is_delivered_by_cutoff
        FROM window_orders""",
    "has_items_flag": """
        SELECT order_id,
               CAST(order_id IN (SELECT order_id FROM f_order_items) AS INTEGER)
                 AS has_order_items
        FROM window_orders""",
    "zero_fill": f"""
        SELECT order_id, {", ".join(ITEM_COUNTS)}, {amounts(ITEM_AMOUNTS)},
               {", ".join(PAYMENT_COUNTS)}, {amounts(PAYMENT_AMOUNTS)},
               {", ".join(RETURN_COUNTS)}, {amounts(RETURN_AMOUNTS)},
               latest_payment_status, last_payment_ts, last_return_request_ts
        FROM base""",
    "order_financials": f"""
        SELECT order_id, is_delivered_by_cutoff,
               {amounts(("net_revenue_uah", "net_item_cost_uah"))}, net_sold_quantity
        FROM financials""",
    "order_metrics": f"""
        SELECT order_id, {amounts(("net_revenue_uah", "gross_profit_uah"))},
               is_fulfilled_and_captured, is_retained_sale, is_fully_reversed_sale
        FROM metrics""",
    "order_level_mart": f"SELECT {_mart_columns(MART_COLUMNS)} FROM mart",
    "kpi_comparison": f"""
        SELECT c.order_year, c.created AS created_orders, c.successful AS successful_orders,
               {amount("c.revenue", "net_revenue_uah")}, {amount("c.profit", "gross_profit_uah")},
               {amount("c.discount", "discount_uah")},
               {amount("c.full_value", "sales_before_discount_uah")},
               c.buyers AS active_customers,
               100 * {_success("c")} AS success_rate_percent,
               100 * {_margin("c")} AS gross_margin_percent,
               100 * {ratio("c.discount", "c.full_value")} AS discount_rate_percent,
               {percent("c.successful - p.successful", "p.successful")} AS orders_yoy_percent,
               {percent("c.revenue - p.revenue", "p.revenue")} AS revenue_yoy_percent,
               {percent("c.profit - p.profit", "p.profit")} AS gross_profit_yoy_percent,
               round(100 * {_margin("c")} - 100 * {_margin("p")}, 2) AS gross_margin_change_pp,
               {percent("c.buyers - p.buyers", "p.buyers")} AS active_customers_yoy_percent
        {_YEAR_PAIR}""",
    "kpi_summary_export": f"""
        SELECT c.order_year, c.created AS created_orders, c.successful AS successful_orders,
               {_success("c")} AS success_rate_percent,
               {amount("c.revenue", "net_revenue_uah")}, {amount("c.profit", "gross_profit_uah")},
               {_margin("c")} AS gross_margin_percent,
               c.buyers AS active_customers,
               {ratio("c.successful - p.successful", "p.successful")} AS orders_yoy_percent,
               {ratio("c.revenue - p.revenue", "p.revenue")} AS revenue_yoy_percent,
               {ratio("c.profit - p.profit", "p.profit")} AS gross_profit_yoy_percent,
               {_margin("c")} - {_margin("p")} AS gross_margin_change_pp,
               {_success("c")} - {_success("p")} AS success_rate_change_pp,
               {ratio("c.buyers - p.buyers", "p.buyers")} AS active_customers_yoy_percent
        {_YEAR_PAIR}""",
    "monthly_yoy": f"""
        SELECT order_month, successful AS successful_orders_2025,
               successful_before AS successful_orders_2024,
               {percent("successful - successful_before", "successful_before")}
                 AS orders_yoy_percent,
               {amount("profit", "gross_profit_2025_uah")},
               {amount("profit_before", "gross_profit_2024_uah")},
               {percent("profit - profit_before", "profit_before")} AS gross_profit_yoy_percent
        FROM monthly_lagged WHERE order_year = 2025""",
    "monthly_kpis_export": f"""
        SELECT order_month, order_year, created AS created_orders,
               successful AS successful_orders,
               {ratio("successful", "created")} AS success_rate_percent,
               {amount("revenue", "net_revenue_uah")}, {amount("profit", "gross_profit_uah")},
               {ratio("profit", "revenue")} AS gross_margin_percent,
               {ratio("discount", "full_value")} AS discount_rate_percent,
               {ratio("successful - successful_before", "successful_before")}
                 AS orders_yoy_percent,
               {ratio("profit - profit_before", "profit_before")} AS gross_profit_yoy_percent
        FROM monthly_lagged WHERE order_year = 2025""",
    "customer_mix": f"""
        SELECT m.order_year, customer_type, customers,
               {percent("customers", "total")} AS customer_share_percent
        FROM mix m JOIN (SELECT order_year, sum(customers) AS total FROM mix GROUP BY ALL) t
          ON t.order_year = m.order_year""",
    "customer_mix_export": f"""
        SELECT m.order_year, customer_type, customers,
               {ratio("customers", "total")} AS customer_share_percent
        FROM mix m JOIN (SELECT order_year, sum(customers) AS total FROM mix GROUP BY ALL) t
          ON t.order_year = m.order_year""",
    "discount_scenario": f"""
        SELECT {amount("value_now", "sales_2025_before_discount_uah")},
               {percent("discount_before", "value_before")} AS discount_rate_2024_percent,
               {percent("discount_now", "value_now")} AS discount_rate_2025_percent,
               {amount("discount_now", "actual_discount_2025_uah")},
               round(CAST(value_now AS DOUBLE) * {ratio("discount_before", "value_before")}, 2)
                 AS discount_at_2024_rate_uah,
               round(CAST(discount_now AS DOUBLE)
                     - CAST(value_now AS DOUBLE) * {ratio("discount_before", "value_before")}, 2)
                 AS incremental_discount_scenario_uah
        FROM rates WHERE years = 2""",
    "category_profit_change": f"""
        SELECT category, {amount("profit_before", "gross_profit_2024_uah")},
               {amount("profit_now", "gross_profit_2025_uah")},
               {amount("profit_now - profit_before", "gross_profit_change_uah")},
               if(profit_now >= profit_before, 'Growth', 'Decline') AS profit_change_direction
        FROM category_years""",
    "category_summary_export": f"""
        SELECT category, {amount("profit_before", "gross_profit_2024_uah")},
               {amount("profit_now", "gross_profit_2025_uah")},
               {amount("profit_now - profit_before", "gross_profit_change_uah")},
               {ratio("discount_before", "value_before")} AS discount_rate_2024_percent,
               {ratio("discount_now", "value_now")} AS discount_rate_2025_percent,
               {ratio("profit_now", "net_now")} AS gross_margin_2025_percent,
               if(profit_now >= profit_before, 'Growth', 'Decline') AS category_result
        FROM category_years""",
    "region_targets": f"""
        SELECT region, orders AS orders_actual, orders_goal AS orders_target,
               {percent("orders", "orders_goal")} AS orders_target_attainment_percent,
               {amount("profit", "gross_profit_actual_uah")},
               {amount("profit_goal", "gross_profit_target_uah")},
               {percent("profit", "profit_goal")} AS gross_profit_target_attainment_percent
        FROM regions""",
    "region_summary_export": f"""
        SELECT region, made AS orders_actual, coalesce(successful, 0) AS successful_orders,
               orders_goal AS orders_target,
               {ratio("made", "orders_goal")} AS orders_target_attainment_percent,
               {amount("earned", "gross_profit_actual_uah")},
               {amount("profit_goal", "gross_profit_target_uah")},
               {ratio("earned", "profit_goal")} AS gross_profit_target_attainment_percent,
               CASE concat(CAST(made >= orders_goal AS INTEGER),
                           CAST(earned >= profit_goal AS INTEGER))
                    WHEN '11' THEN 'Both met' WHEN '10' THEN 'Orders met, profit missed'
                    WHEN '01' THEN 'Profit met, orders missed' ELSE 'Both missed' END
                 AS target_status
        FROM (SELECT *, coalesce(orders, 0) AS made, coalesce(profit, 0) AS earned FROM regions)""",
}


_YEARS = "year(o_orderdate)"

# The building blocks on the raw test tables.
HELPERS = {
    "helper_row_counts": _union(
        *[
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}"
            for name in (
                "customer",
                "orders",
                "lineitem",
                "part",
                "supplier",
                "events",
                "documents",
            )
        ]
    ),
    "helper_duplicate_keys": _union(
        _duplicates("orders.o_custkey", "orders", "o_custkey"),
        _duplicates("lineitem.l_orderkey", "lineitem", "l_orderkey"),
        _duplicates("part.p_partkey", "part", "p_partkey"),
    ),
    "helper_orphans": _union(
        _orphans("orders -> lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
        _orphans("customer -> orders", "customer", "c_custkey", "orders", "o_custkey"),
    ),
    "helper_flag_counts": """
        SELECT count(*) AS total_lines, count(*) FILTER (l_discount = 0) AS undiscounted,
               count(*) FILTER (l_quantity >= 40) AS bulk,
               count(*) FILTER (l_returnflag = 'R') AS returned
        FROM lineitem""",
    "helper_sum_where": """
        SELECT l_returnflag,
               CAST(sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE 0 END) AS BIGINT)
                 AS open_pieces,
               CAST(sum(CASE l_linestatus WHEN 'O' THEN 0 ELSE l_quantity END) AS BIGINT)
                 AS other_pieces,
               count(*) FILTER (l_linestatus = 'O') AS open_lines
        FROM lineitem GROUP BY ALL""",
    "helper_latest_by": """
        SELECT o_custkey, o_orderstatus AS latest_status FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey
                                   ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "helper_normalize_label": """
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High'
                    WHEN '4-NOT SPECIFIED' THEN 'Unknown' ELSE o_orderpriority END AS priority,
               count(*) AS order_count
        FROM orders GROUP BY ALL""",
    "helper_safe_ratio": """
        SELECT c_nationkey, CAST(overdrawn AS DOUBLE) / nullif(rich, 0) AS overdrawn_per_rich,
               round(100 * (CAST(overdrawn AS DOUBLE) / everyone), 2) AS overdrawn_percent
        FROM (SELECT c_nationkey, count(*) AS everyone,
                     count(*) FILTER (c_acctbal < 0) AS overdrawn,
                     count(*) FILTER (c_acctbal > 9990) AS rich
              FROM customer GROUP BY ALL)""",
    "helper_yoy_lag": f"""
        SELECT CAST(y AS INTEGER) AS order_year, n AS order_count,
               round(100 * (CAST(n - before AS DOUBLE) / before), 2) AS orders_yoy_percent
        FROM (SELECT *, (SELECT n FROM (SELECT {_YEARS} AS y, count(*) AS n FROM orders
                                        GROUP BY ALL) p
                         WHERE p.y = c.y - 1) AS before
              FROM (SELECT {_YEARS} AS y, count(*) AS n FROM orders GROUP BY ALL) c)""",
    "helper_yoy_months": f"""
        SELECT make_date(1997, m, 1) AS order_month, now_count AS order_count,
               nullif(before_count, 0) AS previous_order_count
        FROM (SELECT month(o_orderdate) AS m, count(*) FILTER ({_YEARS} = 1997) AS now_count,
                     count(*) FILTER ({_YEARS} = 1996) AS before_count
              FROM orders GROUP BY ALL)
        WHERE now_count > 0""",
    "helper_share_of_total": f"""
        SELECT CAST(y AS INTEGER) AS order_year, o_orderpriority, n AS order_count,
               CAST(n AS DOUBLE) / total AS share
        FROM (SELECT {_YEARS} AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
        JOIN (SELECT {_YEARS} AS y, count(*) AS total FROM orders GROUP BY ALL) USING (y)""",
    "helper_pivot_max": f"""
        SELECT o_orderpriority,
               nullif(count(*) FILTER ({_YEARS} = 1995), 0) AS orders_1995,
               nullif(count(*) FILTER ({_YEARS} = 1996), 0) AS orders_1996,
               nullif(count(*) FILTER ({_YEARS} = 1997), 0) AS orders_1997
        FROM orders GROUP BY ALL""",
    "helper_first_event_cohort": f"""
        SELECT DISTINCT o_custkey, first_day, CAST({_YEARS} AS INTEGER) AS order_year
        FROM orders
        JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders
              GROUP BY ALL) USING (o_custkey)
        WHERE {_YEARS} IN (1996, 1997) AND month(o_orderdate) IN (10, 11)""",
    "helper_target_status": """
        SELECT c_nationkey, customers, orders, buyers,
               CASE WHEN orders < 10 * customers
                    THEN if(1000 * buyers < 997 * customers, 'Both missed',
                            'Profit met, orders missed')
                    ELSE if(1000 * buyers < 997 * customers, 'Orders met, profit missed',
                            'Both met') END AS status
        FROM (SELECT c_nationkey, count(DISTINCT c_custkey) AS customers,
                     count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS buyers
              FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
}


def _scan(table: str, *amounts: str) -> str:
    shown = ", ".join(amount(name, name) for name in amounts)
    return f"SELECT * REPLACE ({shown}) FROM f_{table}" if amounts else f"SELECT * FROM f_{table}"


# The tables as the readers open them, and an extract that went through CSV.
SCANS = {
    "scan_orders": _scan("orders", "shipping_fee_uah"),
    "scan_order_items": _scan(
        "order_items", "unit_price_uah", "unit_cost_uah", "item_discount_uah"
    ),
    "scan_customers": _scan("customers"),
    "scan_products": _scan("products"),
    "scan_payments": _scan("payments", "payment_amount_uah"),
    "scan_returns": _scan("returns", "refund_amount_uah"),
    "scan_monthly_targets": f"""
        SELECT strftime(order_ts, '%Y-%m') AS month, shipping_region AS region,
               count(*) AS orders_target,
               {amount("sum(shipping_fee_uah)", "gross_profit_target_uah")}
        FROM f_orders GROUP BY 1, 2""",
    "csv_extract": STATEMENTS["monthly_kpis_export"],
    "csv_kpi_summary": STATEMENTS["kpi_summary_export"],
    "csv_customer_mix": STATEMENTS["customer_mix_export"],
    "csv_region_summary": STATEMENTS["region_summary_export"],
    "csv_category_summary": STATEMENTS["category_summary_export"],
    "order_level_mart_sorted": STATEMENTS["order_level_mart"],
}

# The order of rows in sorted results.
ROW_ORDER = {
    "order_level_mart_sorted": "order_ts NULLS FIRST, order_id NULLS FIRST",
    "kpi_comparison": "order_year",
    "kpi_summary_export": "order_year",
    "monthly_yoy": "order_month",
    "monthly_kpis_export": "order_month",
    "customer_mix": "order_year, customer_type",
    "customer_mix_export": "order_year, customer_type",
    "category_profit_change": "gross_profit_change_uah DESC NULLS LAST",
    "category_summary_export": "gross_profit_change_uah DESC NULLS LAST",
    "region_targets": "orders_target_attainment_percent DESC NULLS LAST",
    "region_summary_export": "orders_target_attainment_percent DESC NULLS LAST",
}


def oracle_statements() -> dict[str, str]:
    shop = {
        name: statement(select)
        + (f"\nORDER BY {ROW_ORDER[name]}" if name in ROW_ORDER else "")
        for name, select in {**STATEMENTS, **SCANS}.items()
    }
    return {**shop, **HELPERS}
