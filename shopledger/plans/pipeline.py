"""The whole analysis as one job: checks, mart, reports, CSV extracts.

    spark-submit run_analysis.py --tables /data/shop --output /data/out
    spark-submit run_analysis.py --tables sales --format table --output /data/out --years 2025 2026

The mart is stored once and every report reads it back, so a lost executor
costs at most one stage of one report. Every report is stored with all its rows.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from shopledger.config import AnalysisConfig
from shopledger.operators import drivers, kpis, quality, targets
from shopledger.operators.order_mart import order_level_mart
from shopledger.session import apply_runtime_settings
from shopledger.sources.sinks import read_mart, write_csv, write_mart, write_report
from shopledger.sources.tables import ShopTables, read_tables, tables_under


def quality_reports(tables: ShopTables) -> dict[str, DataFrame]:
    return {
        "row_counts": quality.table_sizes(tables),
        "duplicate_keys": quality.key_duplicates(tables),
        "orphans": quality.broken_relationships(tables),
        "null_status_profile": quality.missing_values(tables.orders),
        "invalid_items": quality.invalid_items(tables.order_items),
    }


def analysis_reports(
    mart: DataFrame, categories: DataFrame, tables: ShopTables, cfg: AnalysisConfig
) -> dict[str, DataFrame]:
    return {
        "kpi_comparison": kpis.kpi_comparison(mart, cfg),
        "monthly_yoy": kpis.monthly_yoy(mart, cfg),
        "customer_mix": kpis.customer_mix(mart, cfg),
        "discount_scenario": drivers.discount_scenario(mart, tables.order_items, cfg),
        "category_profit_change": drivers.category_profit_change(categories, cfg),
        "region_targets": targets.region_targets(mart, tables.monthly_targets, cfg),
    }


def export_reports(
    mart: DataFrame, categories: DataFrame, tables: ShopTables, cfg: AnalysisConfig
) -> dict[str, DataFrame]:
    """The dashboard extracts by the name of their CSV."""
    return {
        "kpi_summary": kpis.kpi_summary(mart, cfg),
        "monthly_kpis": kpis.monthly_kpis(mart, cfg),
        "customer_mix": kpis.customer_mix_summary(mart, cfg),
        "region_summary": targets.region_summary(mart, tables.monthly_targets, cfg),
        "category_summary": drivers.category_summary(categories, cfg),
    }


def store_mart(
    spark: SparkSession, tables: ShopTables, cfg: AnalysisConfig, output: str
) -> DataFrame:
    """Build and store the mart, and hand back the stored one."""
    write_mart(order_level_mart(tables, cfg), f"{output}/order_level_mart")
    return read_mart(spark, f"{output}/order_level_mart")


def store_category_totals(
    spark: SparkSession, mart: DataFrame, tables: ShopTables, cfg: AnalysisConfig, output: str
) -> DataFrame:
    """Join items, returns and products once for both category reports."""
    totals = drivers.category_totals(
        mart, tables.order_items, tables.products, tables.returns, cfg
    )
    totals.write.mode("overwrite").parquet(f"{output}/category_totals")
    return spark.read.parquet(f"{output}/category_totals")


def write_exports(reports: Mapping[str, DataFrame], output: str) -> None:
    for name, report in reports.items():
        write_csv(report, f"{output}/{name}.csv")


def run(
    spark: SparkSession, tables: ShopTables, output: str, cfg: AnalysisConfig | None = None
) -> dict[str, DataFrame]:
    """Store mart, extracts and reports under ``output``; returns the stored reports."""
    cfg = cfg or AnalysisConfig()
    apply_runtime_settings(spark)
    mart = store_mart(spark, tables, cfg, output)
    categories = store_category_totals(spark, mart, tables, cfg, output)
    write_exports(export_reports(mart, categories, tables, cfg), f"{output}/exports")
    reports = {**quality_reports(tables), **analysis_reports(mart, categories, tables, cfg)}
    stored = {}
    for name, report in reports.items():
        path = f"{output}/reports/{name}"
        write_report(report, path)
        stored[name] = spark.read.schema(report.schema).parquet(path)
    return stored


def _config(options: argparse.Namespace) -> AnalysisConfig:
    """The analysis the options ask for; years alone move the window and cutoff to them."""
    given = {}
    if options.years:
        previous, current = options.years
        given |= {"previous_year": previous, "current_year": current}
        given |= {"window_start": date(previous, 1, 1), "window_end": date(current, 12, 31)}
        given |= {"cutoff": date(current, 12, 31)}
    if options.window:
        given |= dict(zip(("window_start", "window_end"), options.window))
    if options.cutoff:
        given["cutoff"] = options.cutoff
    if options.months:
        given["period_months"] = tuple(options.months)
    return AnalysisConfig(**given)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument(
        "--tables", required=True, help="folder, or with --format table the schema, of the input"
    )
    parser.add_argument("--format", default="parquet", help="format of the input tables, or table")
    parser.add_argument("--output", required=True, help="folder for mart, reports and extracts")
    day = date.fromisoformat
    parser.add_argument("--years", type=int, nargs=2, metavar=("PREVIOUS", "CURRENT"))
    parser.add_argument("--months", type=int, nargs="+", help="calendar months to compare")
    parser.add_argument("--window", type=day, nargs=2, metavar=("FIRST", "LAST"), help="order days")
    parser.add_argument("--cutoff", type=day, help="last day that counts")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("shopledger").getOrCreate()
    tables = read_tables(spark, tables_under(options.tables, options.format), options.format)
    for name in run(spark, tables, options.output, _config(options)):
        print(f"{options.output}/reports/{name}")


if __name__ == "__main__":
    main()
