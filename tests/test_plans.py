"""The physical plans keep what large tables need."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from shopledger.config import AnalysisConfig
from shopledger.functions.frames import left_join_spread
from shopledger.operators import drivers, kpis
from shopledger.operators.order_facts import items_by_order, returns_by_order
from shopledger.operators.order_mart import order_level_mart, rows_of_orders, with_order_facts
from shopledger.sources.sample_shop import sample_tables
from shopledger.sources.sinks import read_mart, write_mart
from shopledger.sources.tables import read_tables, tables_under

SF_DIR = "/root/testdata/sf0.001"
CFG = AnalysisConfig()


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "20000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def large(spark):
    """A session that treats every table as too large to broadcast."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    for name, df in sample_tables(spark, SF_DIR).by_name().items():
        df.write.parquet(f"{root}/{name}")
    return root


@pytest.fixture(scope="module")
def stored_mart(spark, stored):
    tables = read_tables(spark, tables_under(stored))
    write_mart(order_level_mart(tables, CFG), f"{stored}/mart")
    return f"{stored}/mart"


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_no_cross_join_and_no_python(large, name):
    plan = plan_of(entry_points.queries()[name](large, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_orphans_are_counted_before_the_anti_join(large, stored):
    plan = plan_of(entry_points.queries()["dq_orphans"](large, SF_DIR))
    assert plan.count("LeftAnti") == 5
    assert "LeftOuter" not in plan


def test_mart_moves_orders_twice_and_facts_once(large, stored):
    """One exchange to meet customers, one to meet the facts, which meet each other first.

    Facts: payments, returns, and items by order and product, each once by order; their rows
    meet in a union that keeps this partitioning, and move once more to meet the orders, in fresh
    shuffles, so that AQE can split a hot order. The others: customers, items by id, returned ids,
    and both sides of the join of returns with items.
    """
    tables = read_tables(large, tables_under(stored))
    plan = plan_of(order_level_mart(tables, CFG))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L, 4\)", plan)) == 3
    assert plan.count("Exchange") == 3 + 2 + 2 + 1 + 2 + 2
    assert "FullOuter" not in plan


@pytest.mark.parametrize(
    "name", ["order_level_mart_sorted", "region_summary_export", "category_summary_export"]
)
def test_stored_mart_combines_no_items_before_their_shuffle(large, stored, monkeypatch, name):
    """Few lines share a product of an order, or an item id: a hash table of them spills.

    So items cross a shuffle as they are, and only those of the window's orders, or of returned
    ids, are grouped behind it.
    """
    plans = []
    monkeypatch.setattr("shopledger.plans.registry.write_mart", lambda m, _: plans.append(m))
    monkeypatch.setattr("shopledger.plans.registry._STORED", {})
    monkeypatch.setattr("shopledger.plans.registry.read_mart", lambda *_: plans[0])
    entry_points.queries()[name](large, SF_DIR)
    plan = plan_of(plans[0])
    assert not re.search(r"Exchange hashpartitioning\(order_id#\d+L, product_id", plan)
    semi = [line for line in plan.split("\n") if "LeftSemi" in line]
    assert sorted(re.search(r"\[(\w+)#", line).group(1) for line in semi) == [
        "order_id",
        "order_item_id",
    ]
    for key, line in (("order_id", semi[0]), ("order_item_id", semi[1])):
        assert key in line
        left = plan[plan.index(line) :].split("\n")[1:4]
        assert "Sort [" in left[0] and "Exchange hashpartitioning" in left[1]
        assert "Aggregate" not in left[2] and "Project" in left[2]


def test_order_flag_reads_items_alone(large):
    plan = plan_of(entry_points.queries()["has_items_flag"](large, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L, 4\)", plan)) == 1


def test_window_and_columns_reach_the_scan(large, stored):
    tables = read_tables(large, tables_under(stored))
    plan = plan_of(kpis.kpi_comparison(order_level_mart(tables, CFG), CFG))
    orders_scan = next(
        line for line in plan.split("\n") if "FileScan" in line and "order_ts" in line
    )
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", orders_scan).group(1)
    assert "GreaterThanOrEqual(order_ts,2024-01-01" in pushed
    assert "LessThan(order_ts,2026-01-01" in pushed
    assert "shipping_region" not in orders_scan
    assert "latest_payment_status" not in plan


def test_reports_read_only_their_months(spark, stored_mart):
    plan = plan_of(kpis.kpi_comparison(read_mart(spark, stored_mart), CFG))
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "order_month" in pruned
    scanned = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "shipping_city" not in scanned and "net_revenue_uah" in scanned


def test_yearly_kpis_scan_the_mart_once(spark, stored_mart):
    mart = read_mart(spark, stored_mart)
    for report in (kpis.kpi_comparison, kpis.monthly_yoy, kpis.monthly_kpis, kpis.customer_mix):
        assert plan_of(report(mart, CFG)).count("FileScan") == 1


def test_counting_rows_reads_no_columns(spark, stored):
    plan = plan_of(spark.read.parquet(f"{stored}/orders").agg(F.count("*")))
    assert "ReadSchema: struct<>" in plan


def test_products_meet_sums_not_lines(large, stored, stored_mart):
    tables = read_tables(large, tables_under(stored))
    plan = plan_of(
        drivers.category_totals(
            read_mart(large, stored_mart), tables.order_items, tables.products, tables.returns, CFG
        )
    )
    join = plan.index("SortMergeJoin [product_id")
    assert "HashAggregate(keys=[product_id" in plan[join:]


# --- one key holds a third of all rows -----------------------------------------


@pytest.fixture
def skewed(large):
    """Treats a few kilobytes as a large partition, so AQE acts on test data."""
    session = large.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        session.conf.set(key, value)
    return session


def _dimension(session):
    return session.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def test_null_keys_spread_over_tasks(skewed):
    key = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 1000)
    left = skewed.range(0, 60_000, 1, 4).select(F.col("id").alias("row_id"), key.alias("k"))
    joined = left_join_spread(left, _dimension(skewed), "k", "row_id")
    sizes = joined.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 16
    assert max(row["count"] for row in sizes) < 2 * 20_000 / 16
    assert joined.filter("k IS NULL AND v IS NOT NULL").count() == 0
    assert joined.filter("k IS NOT NULL AND v = k * 2").count() == 40_000


def test_hot_key_is_split(skewed):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    left = skewed.range(0, 300_000, 1, 8).select(
        F.col("id").alias("row_id"), key.cast("bigint").alias("k")
    )
    joined = left_join_spread(left, _dimension(skewed), "k", "row_id")
    assert joined.agg(F.count("v")).first()[0] == 300_000
    counted = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    counted.collect()
    assert "skew=true" in plan_of(counted)
    assert max(row.n for row in counted.collect()) < 60_000


@pytest.mark.parametrize("hot", ["7L", "CAST(NULL AS BIGINT)"])
def test_hot_order_of_the_mart_is_split(skewed, hot):
    """A third of the orders under one id, or none: no task has far more than the mean."""
    skewed.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    orders = skewed.range(0, 300_000, 1, 8).selectExpr(
        f"if(id % 3 = 0, {hot}, id) AS order_id",
        "TIMESTAMP_NTZ '2025-01-01' + make_dt_interval(0, 0, 0, id) AS order_ts",
        "if(id % 2 = 0, NULL, id) AS customer_id",
    )
    facts = [
        skewed.range(0, 300_000, 1, 8).selectExpr("id AS order_id", f"1L AS {name}")
        for name in ("order_lines_count", "payment_events_count", "return_requests_count")
    ]
    facts = [f.groupBy("order_id").agg(F.sum(f.columns[1]).alias(f.columns[1])) for f in facts]
    joined = with_order_facts(orders, *facts)
    counted = joined.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n"), F.max("order_ts"), F.max("customer_id")
    )
    sizes = [row.n for row in counted.collect()]
    assert sum(sizes) == 300_000
    assert max(sizes) < 2.5 * sum(sizes) / len(sizes)


def test_hot_order_of_the_items_is_split(skewed):
    """A third of the items under one order, and some under none, an unknown or a repeated one."""
    items = skewed.range(0, 300_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 30 = 1 THEN NULL ELSE id END AS order_id",
        "xxhash64(id) AS product_id",
        "CAST(1 AS INT) AS quantity",
        "CAST(3 AS DECIMAL(18,2)) AS unit_price_uah",
        "CAST(2 AS DECIMAL(18,2)) AS unit_cost_uah",
        "CAST(1 AS DECIMAL(18,2)) AS item_discount_uah",
    )
    orders = skewed.range(0, 150_000, 1, 8).selectExpr("if(id = 9, 7L, id) AS order_id")
    wanted = items.join(orders.distinct(), "order_id")
    kept = rows_of_orders(items, orders)
    assert kept.columns == items.columns
    found, expected = items_by_order(kept), items_by_order(wanted)
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0
    assert found.filter("order_id = 7").first().order_lines_count == 100_001
    assert found.filter("order_id IS NULL OR order_id >= 150000").count() == 0
    counted = kept.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n"), F.max("product_id")
    )
    sizes = [row.n for row in counted.collect()]
    assert "skew=true" in plan_of(counted)
    assert max(sizes) < 60_000


def test_copies_of_an_item_are_not_paired(skewed):
    """A third of items and returns share one id: 10,000 x 100,000 pairs must not appear."""
    items = skewed.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("order_item_id"),
        F.lit(5).cast("decimal(18,2)").alias("unit_cost_uah"),
    )
    returns = skewed.range(0, 300_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 1, id) AS order_item_id",
        "xxhash64(id) AS order_id",
        "'completed' AS return_status",
        "1 AS returned_quantity",
        "CAST(2 AS DECIMAL(18,2)) AS refund_amount_uah",
        "TIMESTAMP_NTZ '2025-01-01' AS return_request_ts",
    )
    facts = returns_by_order(returns, items, CFG)
    counted = facts.agg(
        F.sum("return_requests_count").alias("requests"),
        F.sum("completed_refund_uah").alias("refunds"),
        F.sum("returned_item_cost_uah").alias("costs"),
    )
    # Id 1 is the shared id and one of the plain ones; 19,999 other ids have an
    # item, and 180,000 returns have none.
    pairs = 10_001 * 100_001 + 19_999
    requests = pairs + 180_000
    assert [tuple(row) for row in counted.collect()] == [(requests, 2 * requests, 5 * pairs)]
    assert "skew=true" in plan_of(counted)


def test_hot_order_of_a_stored_mart_is_split(skewed, stored_mart, stored):
    tables = read_tables(skewed, tables_under(stored))
    hot = F.when(F.col("order_item_id") % 3 == 0, F.lit(5)).otherwise(F.col("order_id"))
    items = tables.order_items.repartition(8).withColumn("order_id", hot)
    for _ in range(3):
        items = items.union(items)
    totals = drivers.category_totals(
        read_mart(skewed, stored_mart), items, tables.products, tables.returns, CFG
    )
    assert totals.collect()
    final = plan_of(totals).split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true) [order_id" in final
