"""Every registered query against its DuckDB twin, values and types."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from oracle.statements import ROW_ORDER, oracle_statements
from shopledger.functions.columns import MONEY
from shopledger.operators.order_facts import items_by_order, payments_by_order, returns_by_order
from shopledger.operators.order_mart import order_level_mart
from shopledger.plans.registry import CFG, QUERIES as SHOP_QUERIES
from shopledger.sources.sample_shop import sample_tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
QUERIES = {name: entry_points.queries()[name] for name in SHOP_QUERIES}
ORACLE = oracle_statements()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLE[name])
    columns = [(d[0], str(d[1])) for d in expected.description]
    assert [(f.name, TYPES[f.dataType.simpleString()]) for f in result.schema] == columns
    rows = [tuple(row) for row in result.collect()]
    wanted = expected.fetchall()
    assert rows
    assert _sorted(rows) == _sorted(wanted)
    if name in ROW_ORDER:
        keys = [part.split()[0] for part in ROW_ORDER[name].split(", ")]
        at = [result.columns.index(key) for key in keys]
        assert [[row[i] for i in at] for row in rows] == [[row[i] for i in at] for row in wanted]


def test_entry_runs_the_flagship_query(spark):
    result = entry_points.entry(spark)
    assert result.columns[0] == "order_year"
    assert result.count() == 2


@pytest.mark.parametrize(
    "name, amount",
    [
        ("order_level_mart", "gross_profit_uah"),
        ("items_by_order", "item_sales_before_returns_uah"),
        ("payments_by_order", "retained_payment_uah"),
        ("returns_by_order", "completed_refund_uah"),
    ],
)
def test_decimals_are_exact(spark, duck, name, amount):
    """Sums of the amounts as decimals, before anything becomes a DOUBLE."""
    tables = sample_tables(spark, SF_DIR)
    built = {
        "order_level_mart": lambda: order_level_mart(tables, CFG),
        "items_by_order": lambda: items_by_order(tables.order_items),
        "payments_by_order": lambda: payments_by_order(tables.payments, CFG),
        "returns_by_order": lambda: returns_by_order(tables.returns, tables.order_items, CFG),
    }[name]()
    assert built.schema[amount].dataType == MONEY
    (found,) = built.agg(F.sum(amount)).first()
    sql = f"SELECT sum(CAST({amount} AS DECIMAL(38,2))) FROM ({ORACLE[name]})"
    assert found == duck.execute(sql).fetchone()[0]


def test_the_oracle_stands_alone():
    folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "oracle")
    for file in os.listdir(folder):
        if file.endswith(".py"):
            with open(os.path.join(folder, file)) as source:
                assert "shopledger" not in source.read()
