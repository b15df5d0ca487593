"""Stored mart, extracts and the whole job."""

import csv
import glob
import os

import pytest

from shopledger.config import AnalysisConfig
from shopledger.operators import kpis
from shopledger.operators.order_mart import MART_COLUMNS, order_level_mart
from shopledger.plans import pipeline
from shopledger.session import apply_runtime_settings, scratch_folder, table_state
from shopledger.sources.sample_shop import sample_tables
from shopledger.sources.sinks import read_mart, write_csv, write_mart
from shopledger.sources.tables import SCHEMAS, read_table, read_tables, tables_under

SF_DIR = "/root/testdata/sf0.001"
CFG = AnalysisConfig()
EXTRACTS = (
    "kpi_summary",
    "monthly_kpis",
    "customer_mix",
    "region_summary",
    "category_summary",
)


@pytest.fixture(scope="module")
def raw_tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for name, df in sample_tables(spark, SF_DIR).by_name().items():
        df.write.parquet(f"{root}/{name}")
    return root


@pytest.fixture(scope="module")
def finished_job(spark, raw_tables, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("output"))
    reports = pipeline.run(spark, read_tables(spark, tables_under(raw_tables)), output)
    return output, reports


def test_stored_mart_equals_the_built_one(spark, raw_tables, finished_job):
    output, _ = finished_job
    stored = read_mart(spark, f"{output}/order_level_mart")
    built = order_level_mart(read_tables(spark, tables_under(raw_tables)), CFG)
    assert tuple(stored.columns) == MART_COLUMNS
    assert stored.schema.simpleString() == built.schema.simpleString()
    assert stored.exceptAll(built).count() == 0
    assert stored.count() == built.count() > 0


def test_mart_is_laid_out_by_month_and_replaced(spark, finished_job, tmp_path):
    output, _ = finished_job
    mart = read_mart(spark, f"{output}/order_level_mart")
    months = glob.glob(f"{output}/order_level_mart/order_month=*")
    assert len(months) == mart.select("order_month").distinct().count()
    target = str(tmp_path / "mart")
    write_mart(mart, target)
    write_mart(mart.filter("order_year = 2025"), target)
    assert read_mart(spark, target).select("order_year").distinct().collect() == [(2025,)]


def test_mart_as_catalog_table(spark, finished_job, tmp_path):
    output, _ = finished_job
    mart = read_mart(spark, f"{output}/order_level_mart")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop_test LOCATION '{tmp_path}/db'")
    try:
        write_mart(mart, "shop_test.order_level_mart", "table")
        stored = read_mart(spark, "shop_test.order_level_mart", "table")
        assert stored.exceptAll(mart).count() == 0
    finally:
        spark.sql("DROP DATABASE shop_test CASCADE")


def test_reports_of_the_job(finished_job):
    _, reports = finished_job
    assert list(reports) == [
        "row_counts",
        "duplicate_keys",
        "orphans",
        "null_status_profile",
        "invalid_items",
        "kpi_comparison",
        "monthly_yoy",
        "customer_mix",
        "discount_scenario",
        "category_profit_change",
        "region_targets",
    ]
    for report in reports.values():
        assert report.count() > 0


@pytest.mark.parametrize("name", EXTRACTS)
def test_extract_is_one_csv_with_a_header(spark, raw_tables, finished_job, name):
    output, _ = finished_job
    files = glob.glob(f"{output}/exports/{name}.csv/part-*.csv")
    assert len(files) == 1
    tables = read_tables(spark, tables_under(raw_tables))
    mart = read_mart(spark, f"{output}/order_level_mart")
    categories = spark.read.parquet(f"{output}/category_totals")
    report = pipeline.export_reports(mart, categories, tables, CFG)[name]
    with open(files[0], newline="") as file:
        header, *lines = list(csv.reader(file))
    assert header == report.columns
    assert len(lines) == report.count()
    first = [str(v) if v is not None else "" for v in report.first()]
    numeric = [i for i, f in enumerate(report.schema) if f.dataType.typeName() == "double"]
    for i, (written, expected) in enumerate(zip(lines[0], first, strict=True)):
        if i in numeric and expected:
            assert float(written) == float(expected)
        else:
            assert written == expected


def test_unknown_values_are_empty_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1)
    write_csv(df, str(tmp_path / "t.csv"))
    (file,) = glob.glob(str(tmp_path / "t.csv" / "part-*.csv"))
    assert open(file).read() == "a,b\n1,\n2,x\n"


def test_tables_from_csv_and_catalog(spark, raw_tables, tmp_path):
    payments = read_table(spark, "payments", f"{raw_tables}/payments")
    write_csv(payments, str(tmp_path / "payments"))
    from_csv = read_table(spark, "payments", str(tmp_path / "payments"), "csv")
    assert from_csv.schema == SCHEMAS["payments"]
    assert from_csv.exceptAll(payments).count() == 0
    payments.createOrReplaceTempView("payments_view")
    from_catalog = read_table(spark, "payments", "payments_view", "table")
    assert from_catalog.exceptAll(payments).count() == 0


def test_stored_types_may_be_wider(spark, raw_tables, tmp_path):
    items = read_table(spark, "order_items", f"{raw_tables}/order_items")
    wide = items.withColumn("quantity", items.quantity.cast("bigint")).withColumn(
        "unit_cost_uah", items.unit_cost_uah.cast("decimal(38,9)")
    )
    wide.write.parquet(str(tmp_path / "items"))
    assert read_table(spark, "order_items", str(tmp_path / "items")).exceptAll(items).count() == 0
    orders = read_table(spark, "orders", f"{raw_tables}/orders")
    zoned = orders.withColumn("order_ts", orders.order_ts.cast("timestamp"))
    zoned.write.parquet(str(tmp_path / "orders"))
    again = read_table(spark, "orders", str(tmp_path / "orders"))
    assert again.schema == SCHEMAS["orders"]
    assert again.exceptAll(orders).count() == 0


def test_missing_locations_are_named(spark):
    with pytest.raises(ValueError, match="payments"):
        read_tables(spark, {n: n for n in SCHEMAS if n != "payments"})


def test_job_from_the_command_line(raw_tables, tmp_path, capfd, spark):
    pipeline.main(["--tables", raw_tables, "--output", str(tmp_path)])
    assert f"{tmp_path}/reports/kpi_comparison" in capfd.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/reports/orphans").count() == 5
    stored = read_mart(spark, f"{tmp_path}/order_level_mart")
    assert kpis.kpi_comparison(stored, CFG).count() == 2


def test_job_on_catalog_tables_for_other_years(spark, raw_tables, tmp_path):
    spark.sql(f"CREATE DATABASE shop_source LOCATION '{tmp_path}/db'")
    try:
        for name in SCHEMAS:
            spark.read.parquet(f"{raw_tables}/{name}").write.saveAsTable(f"shop_source.{name}")
        options = ["--format", "table", "--years", "2023", "2024", "--months", "3", "4"]
        pipeline.main(["--tables", "shop_source", "--output", str(tmp_path / "out"), *options])
    finally:
        spark.sql("DROP DATABASE shop_source CASCADE")
    mart = read_mart(spark, f"{tmp_path}/out/order_level_mart")
    assert [r[0] for r in mart.select("order_year").distinct().sort("order_year").collect()] == [
        2023,
        2024,
    ]
    report = spark.read.parquet(f"{tmp_path}/out/reports/kpi_comparison")
    assert sorted(r.order_year for r in report.collect()) == [2023, 2024]


def test_reports_keep_every_row(spark, raw_tables, tmp_path):
    tables = tables_under(raw_tables)
    products = spark.read.parquet(tables["products"])
    products.selectExpr("product_id", "concat('category ', product_id) AS category").write.parquet(
        str(tmp_path / "products")
    )
    tables["products"] = str(tmp_path / "products")
    output = str(tmp_path / "out")
    pipeline.run(spark, read_tables(spark, tables), output)
    mart = read_mart(spark, f"{output}/order_level_mart")
    categories = spark.read.parquet(f"{output}/category_totals")
    report = spark.read.parquet(f"{output}/reports/category_profit_change")
    built = pipeline.analysis_reports(mart, categories, read_tables(spark, tables), CFG)
    assert report.count() == built["category_profit_change"].count() > 100


def test_a_mart_is_replaced_whole_in_a_dynamic_session(spark, finished_job, tmp_path):
    output, _ = finished_job
    session = spark.newSession()
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    mart, target = read_mart(session, f"{output}/order_level_mart"), str(tmp_path / "mart")
    write_mart(mart, target)
    write_mart(mart.filter("order_year = 2025"), target)
    assert {r[0] for r in read_mart(session, target).select("order_year").collect()} == {2025}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_timestamps_are_utc_in_every_session(spark, raw_tables, tmp_path, zone):
    orders = read_table(spark, "orders", f"{raw_tables}/orders")
    orders.withColumn("order_ts", orders.order_ts.cast("timestamp")).write.parquet(
        str(tmp_path / "orders")
    )
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    again = read_table(session, "orders", str(tmp_path / "orders"))
    want = session.read.parquet(f"{raw_tables}/orders").select(*again.columns)
    assert again.exceptAll(want).count() == 0 and again.count() == want.count()


@pytest.mark.parametrize(
    "column, value", [("unit_cost_uah", "0.0049BD"), ("quantity", "1.5D"), ("order_id", "'x'")]
)
def test_values_that_would_change_raise(spark, raw_tables, tmp_path, column, value):
    items = spark.read.parquet(f"{raw_tables}/order_items").limit(3)
    items.selectExpr(
        *[f"{value} AS {c}" if c == column else c for c in items.columns]
    ).write.parquet(str(tmp_path / "items"))
    with pytest.raises(Exception, match=f"{column} does not fit"):
        read_table(spark, "order_items", str(tmp_path / "items")).collect()


def test_an_empty_shop_has_empty_reports(spark, raw_tables, tmp_path):
    for name in SCHEMAS:
        empty = spark.read.parquet(f"{raw_tables}/{name}").limit(0)
        empty.write.parquet(str(tmp_path / "raw" / name))
    output = str(tmp_path / "out")
    reports = pipeline.run(spark, read_tables(spark, tables_under(str(tmp_path / "raw"))), output)
    mart = read_mart(spark, f"{output}/order_level_mart")
    assert mart.count() == 0 and tuple(mart.columns) == MART_COLUMNS
    assert reports["row_counts"].count() == 7
    assert reports["monthly_yoy"].count() == reports["region_targets"].count() == 0


def test_scratch_is_under_a_folder_of_the_session(spark):
    session = spark.newSession()
    warehouse = session.conf.get("spark.sql.warehouse.dir")
    root = session.conf.get("spark.checkpoint.dir", None) or warehouse
    assert scratch_folder(session).startswith(f"{root}/shopledger-")
    assert scratch_folder(session) != scratch_folder(session)


def test_a_changed_table_has_another_state(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)
    before = table_state(spark, path)
    assert table_state(spark, path) == before
    os.utime(path, (1, 1))
    spark.range(30).write.mode("append").parquet(path)
    assert table_state(spark, path) != before


def test_a_nested_file_replaced_in_place_has_another_state(spark, tmp_path):
    """The folder above does not change, nor does the length of the file."""
    path = str(tmp_path / "table")
    spark.range(20).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(path)
    before = table_state(spark, path)
    nested = next(tmp_path.glob("table/part=1/*.parquet"))
    nested.write_bytes(nested.read_bytes())
    os.utime(nested, (5, 5))
    assert table_state(spark, path) != before
    assert len(before) == len(list(tmp_path.glob("table/part=*/*.parquet")))


def test_settings_of_the_session_win(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    session.conf.set("spark.sql.ansi.enabled", "false")
    apply_runtime_settings(session)
    assert session.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    # Without it, sums that do not fit would wrap around in silence.
    assert session.conf.get("spark.sql.ansi.enabled") == "true"
