"""The seven shop tables as DuckDB CTEs over the test tables (see FIXTURES.md)."""

# Fixed values, stated here on their own so that a change in the package shows up.
RAW_REGIONS = (
    "Dnipropetrovsk",
    "dnipropetrovska",
    "Ivano-Frankivsk",
    "ivano  frankivsk",
    "Kharkiv",
    "KHARKIV",
    "Kyiv",
    "Kyiv-City",
    " Lviv ",
    "Odesa",
    "Odessa",
    "Poltava",
    "Vinnytsia",
    "Zaporizhia",
    "zaporizhzhia",
    "Chernihiv",
    None,
    "kyiv city",
    "Lviv",
)
TARGET_REGIONS = (
    "Dnipropetrovsk",
    "Ivano-Frankivsk",
    "Kharkiv",
    "Kyiv",
    "Kyiv City",
    "Lviv",
    "Odesa",
    "Poltava",
    "Vinnytsia",
    "Zaporizhzhia",
    "Sumy",
)
TARGET_MONTHS = (
    "2025-09",
    "2025-10",
    "2025-11",
    "2025-12",
)


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_regions = ", ".join(f"({i}, {_quoted(name)})" for i, name in enumerate(RAW_REGIONS))
_targets = ", ".join(
    f"('{month}', '{region}', {k})"
    for month in TARGET_MONTHS
    for k, region in enumerate(TARGET_REGIONS)
)

_ITEM_ID = """CASE WHEN l_partkey % 601 = 6 THEN -l_partkey
    ELSE 1000000 * l_orderkey + (1009 * l_partkey + 13 * l_suppkey + l_linenumber) % 1000000 END"""


def _moved(day: str, extra: str = "0") -> str:
    return f"CAST(CAST({day} AS DATE) + CAST(10227 + {extra} AS INTEGER) AS TIMESTAMP)"


_PRICE = "CAST(900 + l_partkey % 100 AS DECIMAL(18,2))"

SHOP = {
    "f_orders": f"""
    SELECT o_orderkey AS order_id,
           CASE WHEN o_orderkey % 10 = 3 THEN NULL
                WHEN o_orderkey % 97 = 5 THEN -o_custkey
                ELSE o_custkey END AS customer_id,
           {_moved("o_orderdate")} + (o_orderkey % 24) * INTERVAL '1' HOUR AS order_ts,
           CASE WHEN o_orderkey % 13 = 7 THEN 'cancelled'
                WHEN o_orderkey % 17 = 4 THEN 'shipped' ELSE 'delivered' END AS order_status,
           CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'app'
                ELSE 'marketplace' END AS order_channel,
           CASE o_orderkey % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
           raw.region AS shipping_region,
           concat('City ', CAST(o_orderkey % 40 AS VARCHAR)) AS shipping_city,
           CAST(50 + o_orderkey % 100 AS DECIMAL(18,2)) AS shipping_fee_uah,
           {_moved("o_orderdate", "5")} AS promised_delivery_ts,
           CASE WHEN o_orderkey % 13 = 7 OR o_orderkey % 17 = 4 OR o_orderkey % 29 = 6 THEN NULL
                ELSE {_moved("o_orderdate", "3 + o_orderkey % 6")} END AS delivered_ts
    FROM orders JOIN (VALUES {_regions}) AS raw(remainder, region)
      ON o_orderkey % 19 = raw.remainder""",
    "f_order_items": f"""
    SELECT {_ITEM_ID} AS order_item_id,
           CASE WHEN l_orderkey % 499 = 11 THEN -l_orderkey
                ELSE l_orderkey END AS order_id,
           CASE WHEN l_partkey % 211 = 3 THEN -l_partkey
                ELSE l_partkey END AS product_id,
           CASE WHEN l_partkey % 307 = 1 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
           CASE WHEN l_partkey % 401 = 2 THEN CAST(-1 AS DECIMAL(18,2))
                ELSE {_PRICE} END AS unit_price_uah,
           CASE WHEN l_partkey % 607 = 7 THEN CAST(-1 AS DECIMAL(18,2))
                ELSE CAST(500 + l_partkey % 90 AS DECIMAL(18,2)) END AS unit_cost_uah,
           CASE WHEN l_partkey % 503 = 4 THEN CAST(100000 AS DECIMAL(18,2))
                WHEN l_partkey % 509 = 5 THEN CAST(-5 AS DECIMAL(18,2))
                ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) * {_PRICE}
                          * CAST(l_quantity AS INTEGER) AS DECIMAL(18,2)) END AS item_discount_uah
    FROM lineitem""",
    "f_customers": """
    SELECT c_custkey AS customer_id,
           CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS acquisition_channel,
           CASE WHEN c_acctbal < 0 THEN 'bronze' WHEN c_acctbal < 5000 THEN 'silver'
                ELSE 'gold' END AS loyalty_tier,
           r_name AS home_region, n_name AS home_city,
           CAST(1950 + c_custkey % 55 AS INTEGER) AS birth_year,
           CAST(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS signup_ts
    FROM customer JOIN nation ON c_nationkey = n_nationkey
                  JOIN region ON n_regionkey = r_regionkey""",
    "f_products": """
    SELECT p_partkey AS product_id, p_type AS category FROM part""",
    "f_payments": f"""
    SELECT o_orderkey AS order_id, 1 AS payment_sequence,
           CASE WHEN o_orderkey % 7 = 2 THEN 'failed' WHEN o_orderkey % 23 = 8 THEN 'pending'
                ELSE 'captured' END AS payment_status,
           CAST(o_totalprice AS DECIMAL(18,2)) AS payment_amount_uah,
           {_moved("o_orderdate")} AS payment_ts
    FROM orders
    UNION ALL
    SELECT o_orderkey, 2, 'captured', CAST(o_totalprice AS DECIMAL(18,2)),
           {_moved("o_orderdate", "1")}
    FROM orders WHERE o_orderkey % 14 = 2
    UNION ALL
    SELECT CASE WHEN o_orderkey % 199 = 9 THEN -o_orderkey ELSE o_orderkey END, 3,
           CASE WHEN o_orderkey % 2 = 0 THEN 'refunded' ELSE 'chargeback' END,
           CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
                ELSE CAST(100 AS DECIMAL(18,2)) END,
           {_moved("o_orderdate", "13")}
    FROM orders WHERE o_orderkey % 19 = 9""",
    "f_returns": f"""
    SELECT CASE WHEN l_orderkey % 397 = 13 THEN -l_orderkey
                ELSE {_ITEM_ID} END AS order_item_id,
           l_orderkey AS order_id,
           CASE l_orderkey % 5 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved'
                WHEN 2 THEN 'rejected' ELSE 'completed' END AS return_status,
           CASE WHEN l_quantity > 2 THEN 2 ELSE 1 END AS returned_quantity,
           CAST(1500 AS DECIMAL(18,2)) AS refund_amount_uah,
           {_moved("l_shipdate", "10")} AS return_request_ts
    FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 4 = 1""",
    "f_monthly_targets": f"""
    SELECT month, region, CAST(10 + k AS BIGINT) AS orders_target,
           CAST(CASE WHEN k IN (3, 8) THEN 100000 ELSE 2000000 + 500000 * k END
                AS DECIMAL(18,2)) AS gross_profit_target_uah
    FROM (VALUES {_targets}) AS t(month, region, k)""",
}
