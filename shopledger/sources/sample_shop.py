"""The seven shop tables derived row by row from the TPC-H-like test tables.

Order dates move 28 years forward, which keeps the calendar and puts 1996/1997
on 2024/2025. Remainders of the keys plant every data problem the reports look
for (guests, orphans, duplicates, bad values, dirty region names, reversals).
Nothing here shuffles: each derived row needs one source row, plus the nation
and region of a customer, so a hot source key costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopledger.sources.tables import SCHEMAS, ShopTables

# Fixed value: 28 years in days.
DAYS_FORWARD = 10_227

# Raw spelling of the shipping region by order key modulo 19.
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

# Regions with monthly targets; Sumy has no orders.
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
TARGET_MONTHS = ("2025-09", "2025-10", "2025-11", "2025-12")


def _select(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """Project expressions to the columns and types of one shop table."""
    return df.selectExpr(
        *[f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}"
          for f in SCHEMAS[table]]
    )


def _pick(selector: str, values: tuple[str | None, ...]) -> str:
    """The value at the position given by a remainder."""
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"get(array({listed}), CAST({selector} AS INT))"


def _moved(day: str, extra: str = "0") -> str:
    shift = f"CAST({DAYS_FORWARD} + {extra} AS INT)"
    return f"CAST(date_add(CAST({day} AS DATE), {shift}) AS TIMESTAMP_NTZ)"


def _unknown(key: str) -> str:
    """A key that matches nothing: real ones are positive."""
    return f"-{key}"


def _amount(value: str) -> str:
    return f"CAST({value} AS DECIMAL(18,2))"


# A row-local item id: the order and one of a million slots, given by the line's
# other keys; a few parts share one id everywhere. Numbering the lines within an
# order would need every line of that order in one task.
_SLOT = "(l_partkey * 1009 + l_suppkey * 13 + l_linenumber) % 1000000"
_ITEM_ID = f"if(l_partkey % 601 = 6, -l_partkey, l_orderkey * 1000000 + {_SLOT})"


def sample_orders(orders: DataFrame) -> DataFrame:
    undelivered = "o_orderkey % 13 = 7 OR o_orderkey % 17 = 4 OR o_orderkey % 29 = 6"
    hours = "make_dt_interval(0, CAST(o_orderkey % 24 AS INT))"
    return _select(
        orders,
        "orders",
        order_id="o_orderkey",
        customer_id=f"""CASE WHEN o_orderkey % 10 = 3 THEN NULL
            WHEN o_orderkey % 97 = 5 THEN {_unknown("o_custkey")} ELSE o_custkey END""",
        order_ts=f"{_moved('o_orderdate')} + {hours}",
        order_status="""CASE WHEN o_orderkey % 13 = 7 THEN 'cancelled'
            WHEN o_orderkey % 17 = 4 THEN 'shipped' ELSE 'delivered' END""",
        order_channel=_pick("o_orderkey % 3", ("web", "app", "marketplace")),
        device_type=_pick("o_orderkey % 2", ("mobile", "desktop")),
        shipping_region=_pick(f"o_orderkey % {len(RAW_REGIONS)}", RAW_REGIONS),
        shipping_city="concat('City ', o_orderkey % 40)",
        shipping_fee_uah="50 + o_orderkey % 100",
        promised_delivery_ts=_moved("o_orderdate", "5"),
        delivered_ts=f"if({undelivered}, NULL, {_moved('o_orderdate', '3 + o_orderkey % 6')})",
    )


def sample_order_items(lineitem: DataFrame) -> DataFrame:
    price, cost = _amount("900 + l_partkey % 100"), _amount("500 + l_partkey % 90")
    pieces = "CAST(l_quantity AS INT)"
    # Whole percent of whole prices gives whole cents, which cost less than decimals.
    discount = f"CAST(rint(l_discount * 100) AS INT) * (900 + l_partkey % 100) * {pieces} * 0.01BD"
    return _select(
        lineitem,
        "order_items",
        order_item_id=_ITEM_ID,
        order_id=f"if(l_orderkey % 499 = 11, {_unknown('l_orderkey')}, l_orderkey)",
        product_id=f"if(l_partkey % 211 = 3, {_unknown('l_partkey')}, l_partkey)",
        quantity=f"if(l_partkey % 307 = 1, 0, {pieces})",
        unit_price_uah=f"if(l_partkey % 401 = 2, {_amount('-1')}, {price})",
        unit_cost_uah=f"if(l_partkey % 607 = 7, {_amount('-1')}, {cost})",
        item_discount_uah=f"""CASE WHEN l_partkey % 503 = 4 THEN {_amount("100000")}
            WHEN l_partkey % 509 = 5 THEN {_amount("-5")} ELSE {_amount(discount)} END""",
    )


def sample_customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return _select(
        customer.join(homes, customer.c_nationkey == homes.n_nationkey),
        "customers",
        customer_id="c_custkey",
        acquisition_channel="if(c_custkey % 11 = 0, NULL, c_mktsegment)",
        loyalty_tier="""CASE WHEN c_acctbal < 0 THEN 'bronze' WHEN c_acctbal < 5000 THEN 'silver'
            ELSE 'gold' END""",
        home_region="r_name",
        home_city="n_name",
        birth_year="1950 + c_custkey % 55",
        signup_ts="date_add(DATE '2023-01-01', CAST(c_custkey % 365 AS INT))",
    )


def sample_products(part: DataFrame) -> DataFrame:
    return _select(part, "products", product_id="p_partkey", category="p_type")


def _event(order_id: str, sequence: int, status: str, amount: str, at: str) -> str:
    return f"""struct({order_id} AS order_id, {sequence} AS payment_sequence,
        {status} AS payment_status, {amount} AS payment_amount_uah, {at} AS payment_ts)"""


def sample_payments(orders: DataFrame) -> DataFrame:
    """First attempt, retry and reversal of each order, from one scan."""
    total, day = _amount("o_totalprice"), "o_orderdate"
    tried = """CASE WHEN o_orderkey % 7 = 2 THEN 'failed' WHEN o_orderkey % 23 = 8 THEN 'pending'
        ELSE 'captured' END"""
    attempt = _event("o_orderkey", 1, tried, total, _moved(day))
    retry = _event("o_orderkey", 2, "'captured'", total, _moved(day, "1"))
    reversal = _event(
        f"if(o_orderkey % 199 = 9, {_unknown('o_orderkey')}, o_orderkey)",
        3,
        "if(o_orderkey % 2 = 0, 'refunded', 'chargeback')",
        f"if(o_orderkey % 3 = 0, {total}, {_amount('100')})",
        _moved(day, "13"),
    )
    events = orders.selectExpr(
        f"""inline(array_compact(array({attempt},
            if(o_orderkey % 14 = 2, {retry}, NULL),
            if(o_orderkey % 19 = 9, {reversal}, NULL))))"""
    )
    return _select(events, "payments", **{f.name: f.name for f in SCHEMAS["payments"]})


def sample_returns(lineitem: DataFrame) -> DataFrame:
    return _select(
        lineitem.filter("l_returnflag = 'R' AND l_partkey % 4 = 1"),
        "returns",
        order_item_id=f"if(l_orderkey % 397 = 13, {_unknown('l_orderkey')}, {_ITEM_ID})",
        order_id="l_orderkey",
        return_status="""CASE l_orderkey % 5 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved'
            WHEN 2 THEN 'rejected' ELSE 'completed' END""",
        returned_quantity="if(l_quantity > 2, 2, 1)",
        refund_amount_uah="1500",
        return_request_ts=_moved("l_shipdate", "10"),
    )


def sample_monthly_targets(spark: SparkSession) -> DataFrame:
    """Four months of targets for eleven regions (a constant table)."""
    regions, months = len(TARGET_REGIONS), len(TARGET_MONTHS)
    return _select(
        spark.range(0, regions * months, 1, 1).selectExpr(
            f"id % {regions} AS k", f"id DIV {regions} AS m"
        ),
        "monthly_targets",
        month=_pick("m", TARGET_MONTHS),
        region=_pick("k", TARGET_REGIONS),
        orders_target="10 + k",
        gross_profit_target_uah="if(k IN (3, 8), 100000, 2000000 + 500000 * k)",
    )


def sample_tables(spark: SparkSession, sf_dir: str) -> ShopTables:
    """The shop tables over the test tables in ``sf_dir``."""

    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    derive: dict[str, Callable[[], DataFrame]] = {
        "orders": lambda: sample_orders(raw("orders")),
        "order_items": lambda: sample_order_items(raw("lineitem")),
        "customers": lambda: sample_customers(raw("customer"), raw("nation"), raw("region")),
        "products": lambda: sample_products(raw("part")),
        "payments": lambda: sample_payments(raw("orders")),
        "returns": lambda: sample_returns(raw("lineitem")),
        "monthly_targets": lambda: sample_monthly_targets(spark),
    }
    return ShopTables(lambda name: derive[name]())
