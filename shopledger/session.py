"""Spark settings the pipelines expect."""

from __future__ import annotations

import atexit
import re
from uuid import uuid4

from pyspark.sql import SparkSession

# Runtime settings the pipelines need.
# - UTC: calendar columns are taken from UTC timestamps.
# - ANSI: a sum or product that does not fit raises instead of wrapping around.
# - forceOptimizeSkewedJoin: split a hot join key even when the split costs an
#   extra shuffle further up; one slow task is worse than one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Results depend on these; the others only decide how fast they come.
REQUIRED = ("spark.sql.ansi.enabled",)


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Fill in the runtime settings that nobody chose, and insist on the required ones.

    A setting counts as chosen if it was given when the session was made, or changed
    since to a value other than Spark's own.
    """
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_SETTINGS.items():
        now = spark.conf.get(key)
        chosen = key in explicit or now != _SPARK_DEFAULTS.setdefault(key, _default(spark, key))
        if key in REQUIRED and now != value or not chosen:
            spark.conf.set(key, value)
    return spark


_SPARK_DEFAULTS: dict[str, str] = {}


def _default(spark: SparkSession, key: str) -> str:
    """What Spark itself takes for a setting, whatever this session says."""
    fresh = spark.newSession()
    fresh.conf.unset(key)
    return fresh.conf.get(key)


def local_session(cores: int | str = 8, app: str = "shopledger", **extra: str) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables that every executor can reach.

    Under ``spark.checkpoint.dir``, or else in the session's warehouse. It is removed
    when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/shopledger-{uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have a folder removed when the driver's Python ends."""
    atexit.register(_remove, spark, folder)


def _file_system(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        location, files = _file_system(spark, folder)
        files.delete(location, True)


_ENTRY = re.compile(r"path=(.*?); isDirectory=(\w+);(?: length=(\d+);)?.*?modification_time=(\d+);")


def table_state(spark: SparkSession, path: str) -> tuple:
    """Every file of a table with its length and when it was last changed.

    One listing for each folder, as reading the table takes; also a nested file that is
    replaced by one of equal length gives another state.
    """
    location, files = _file_system(spark, path)
    shown = spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString
    listing = shown(files.listStatus(location))
    found = []
    for name, is_folder, length, changed in _ENTRY.findall(listing):
        hidden = name.rsplit("/", 1)[-1].startswith(("_", "."))
        if is_folder == "true" and not hidden:
            found += table_state(spark, name)
        elif not hidden:
            found.append((name, length, changed))
    return tuple(sorted(found))
