"""Where results go: the stored mart and the CSV extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopledger.operators.order_mart import MART_SCHEMA


def write_mart(mart: DataFrame, target: str, target_format: str = "parquet") -> None:
    """Replace the stored mart: one folder per order month, rows in order time.

    Every reader filters on months, so the folders are what gets pruned. The
    rebalance lets AQE cut a busy month into several files and merge quiet
    ones, where a plain shuffle by month would give it to one task. A global sort
    would range-partition everything only to be lost on the next read.
    """
    laid_out = mart.hint("rebalance", "order_month").sortWithinPartitions(
        "order_month", "order_ts", "order_id"
    )
    # Static: the whole table is replaced, whatever the session says about partitions.
    writer = (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("order_month")
    )
    if target_format == "table":
        writer.format("parquet").saveAsTable(target)
    else:
        writer.format(target_format).save(target)


def read_mart(spark: SparkSession, source: str, source_format: str = "parquet") -> DataFrame:
    """The stored mart with its columns in order; an empty one has no file and still a schema."""
    if source_format == "table":
        stored = spark.table(source)
    else:
        stored = spark.read.schema(MART_SCHEMA).format(source_format).load(source)
    return stored.select([stored[f.name].cast(f.dataType).alias(f.name) for f in MART_SCHEMA])


def write_report(report: DataFrame, path: str) -> None:
    """Replace a stored report, all of its rows, in its order."""
    report.write.mode("overwrite").parquet(path)


def write_csv(report: DataFrame, path: str) -> None:
    """Replace a CSV extract with a header line.

    Reports have a handful of rows, which AQE leaves in one sorted part file; a
    report that grows is split instead of being forced through one task.
    """
    report.write.mode("overwrite").option("header", True).csv(path)
