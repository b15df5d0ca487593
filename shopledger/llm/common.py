"""What the corpus operators share: tables, stored intermediates, Arrow helpers.

Every operator reads only the columns it names; further input columns, whatever
they are called, are left out of its result.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shopledger.session import remove_at_exit

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors reach.

    Only a session on one machine may be without that setting (a test) and gets a temporary folder;
    on a cluster it raises. The folder is removed when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        root = root or tempfile.mkdtemp(prefix="shopledger-shared-")
        _FOLDERS[app] = f"{root.rstrip('/')}/llm-{uuid4().hex}"
        remove_at_exit(spark, _FOLDERS[app])
    return _FOLDERS[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what is stored is neither computed twice nor lost with an executor.
    """
    target = f"{shared_folder(df.sparkSession)}/{uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, as an archive."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="shopledger-package-"), "shopledger_package"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


Batches = Iterator[pa.RecordBatch]
# Bytes of a batch that a function gets at once. What it makes of them, as Python objects, is a
# multiple of that; a text of its own may be longer.
SLICE_BYTES = 4 << 20


def _slices(batches: Batches, limit: int) -> Batches:
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# What modules keep in a worker from task to task, and how to drop it; whose task was the last.
_KEPT: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def kept_by(module: str, drop: Callable[[], None]) -> None:
    """Have a module's memory dropped once a worker does another module's work."""
    _KEPT[module] = drop


def _drop_others(module: str) -> None:
    """What another module's tasks kept goes back to the system before this one's begin."""
    for owner, drop in _KEPT.items():
        if owner != module:
            drop()
    if _LAST != [module]:
        _LAST[:] = [module]
        _give_back()


def _give_back() -> None:
    """Return memory that is free to the system: workers stay, and wait, after a task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(
    df: DataFrame, function: Callable[[Batches], Batches], schema, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""
    ship_package(df.sparkSession)
    module = function.__module__

    def task(batches: Batches) -> Batches:
        _drop_others(module)
        try:
            yield from function(_slices(batches, slice_bytes))
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers, n = column.buffers(), len(column)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[first:last], offsets - first


def row_bytes(column: pa.Array) -> Iterator[bytes]:
    """The rows of a string or binary column as bytes; a null row is empty."""
    data, offsets = text_bytes(column)
    view, at = memoryview(data), offsets.tolist()
    for start, end in zip(at, at[1:]):
        yield bytes(view[start:end])
