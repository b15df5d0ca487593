"""Sharding along a Hilbert curve, so that shards cover small boxes of the metadata.

Every dimension is quantised to ``2**bits`` steps of about equal row counts; a row's
steps are a point of a grid, and its place on the Hilbert curve through the grid is its
index. Rows sorted by index and cut into runs make shards whose minima and maxima are
narrow in all dimensions at once, which is what file pruning needs.

The law is ``rows``: shards differ by at most one row. Ties on the curve are ordered by
text checksum and id, so that equal texts on one point lie next to each other.

A null in a dimension is step zero; strings are ordered by their bytes, and a step begins with
the value at its share of the rows, so a value far from all others takes no step from them. Repeated rows are separate rows. An empty table gives an
empty result, and with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shopledger.llm.common import map_batches, stored


def hilbert_index(steps: list[np.ndarray], bits: int) -> np.ndarray:
    """Distance along the curve of points given as one array of steps per dimension.

    Bits are worked off from the highest: where an axis has the bit, the lower bits of the
    first axis are inverted, else they are swapped with the axis's. A Gray decoding follows.
    """
    x = [np.array(s, np.int64) for s in steps]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            has = (x[axis] >> level) & 1 == 1
            swapped = np.where(has, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swapped)
            if axis:
                x[axis] = x[axis] ^ swapped
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips = np.where((x[-1] >> level) & 1 == 1, flips ^ ((1 << level) - 1), flips)
    x = [a ^ flips for a in x]
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            index = (index << 1) | ((x[axis] >> level) & 1)
    return index


def _string_bounds(df: DataFrame, name: str, n_steps: int) -> list[str]:
    """The first value of each step but the lowest, in steps of about equal row counts.

    Distinct values are counted, sorted by range and numbered by a running sum: within each
    part, after the rows of the parts before it. What reaches the driver is the bounds.
    """
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value"))
    ranged = values.agg(F.count("*").alias("n")).repartitionByRange("value")
    counted = stored(ranged.withColumn("part", F.spark_partition_id()), "values")
    # One row for each sorted part reaches the unpartitioned windows.
    totals = counted.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    step = F.floor(ahead * n_steps / F.col("total"))
    stepped = counted.join(offsets, "part").select("value", step.alias("step"))
    firsts = stepped.groupBy("step").agg(F.min("value").alias("first")).where("step > 0")
    return sorted(row.first for row in firsts.collect())


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int) -> dict[str, Column]:
    """For each dimension its step, the number of bounds at or below the value.

    The bounds are quantiles of all rows: ``2**bits - 1`` values a dimension.
    """
    strings = [x for x in dimensions if isinstance(df.schema[x].dataType, T.StringType)]
    numbers = {x: F.col(x).cast("double") for x in dimensions if x not in strings}
    bounds: dict[str, list] = {x: _string_bounds(df, x, 1 << bits) for x in strings}
    if numbers:
        shares = [k / (1 << bits) for k in range(1, 1 << bits)]
        row = df.agg(
            *[F.percentile_approx(x, shares, 10_000).alias(name) for name, x in numbers.items()]
        ).first()
        bounds |= {name: sorted(set(row[name] or [])) for name in numbers}
    return {x: _step(numbers.get(x, F.col(x)), bounds[x]) for x in dimensions}


def _step(value: Column, bounds: list) -> Column:
    """How many of the bounds the value reaches; none for a null."""
    if not bounds:
        return F.lit(0)
    reached = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda bound: bound <= value)
    return F.coalesce(F.size(reached), F.lit(0))


def _with_index(df: DataFrame, n_steps: int, bits: int) -> DataFrame:
    """Replaces the first ``n_steps`` columns by the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            index = hilbert_index([c.to_numpy() for c in columns[:n_steps]], bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(index), *columns[n_steps:]], ["index", *batch.schema.names[n_steps:]]
            )

    rest = T.StructType(
        [T.StructField("index", T.LongType()), *df.schema.fields[n_steps:]]
    )
    return map_batches(df, run, rest)


def hilbert_shards(
    df: DataFrame,
    dimensions: Sequence[str],
    n_shards: int,
    bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    sort_partitions: int | None = None,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``index``, ``position``, ``shard`` and ``slot`` of every row.

    ``position`` is the place in the whole order, ``slot`` the place within the shard, both
    from 0. Only these few columns are sorted, not the texts. The sorted rows are stored with
    their partition and place in it, so a lost executor cannot change the order; what has
    to be known about other partitions is one count for each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    steps = quantised(df, dimensions, bits)
    slim = _with_index(
        df.select(
            *[step.alias(f"step{k}") for k, step in enumerate(steps.values())],
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ),
        len(steps),
        bits,
    )
    order = ["index", "text_crc32", "doc_id"]
    n_parts = sort_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = stored(
        ranged.select(
            "*",
            F.shiftright(place, 33).cast("int").alias("part"),
            place.bitwiseAND((1 << 33) - 1).alias("row"),
        ),
        "curve",
    )
    # One row for each sorted partition reaches the unpartitioned window.
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n_rows = placed.count()
    base, longer = divmod(n_rows, n_shards)
    position = F.col("start") + F.col("row")
    # The first ``longer`` shards have one row more than the others.
    in_longer = F.col("position") < longer * (base + 1)
    shard = F.when(in_longer, F.floor(F.col("position") / (base + 1))).otherwise(
        longer + F.floor((F.col("position") - longer * (base + 1)) / max(1, base))
    )
    first = F.col("shard") * base + F.least(F.col("shard"), F.lit(longer))
    return (
        placed.join(starts, "part")
        .select("doc_id", "size", "text_crc32", "index", position.alias("position"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("position") - first).cast("long"))
    )


def write_shards(df: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows into one folder for each shard, in curve order within each file."""
    placed = shards.select(F.col("doc_id").alias("_id"), "shard", "position")
    rows = df.join(placed, df[id_col] == F.col("_id")).drop("_id")
    laid_out = rows.hint("rebalance", "shard").sortWithinPartitions("shard", "position")
    laid_out.drop("position").write.mode("overwrite").partitionBy("shard").parquet(path)


def manifest(df: DataFrame, shards: DataFrame, dimensions: Sequence[str], id_col: str = "doc_id"):
    """Rows, and minimum and maximum of each dimension, by shard: what a reader prunes on."""
    placed = shards.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"))
    rows = df.join(placed, df[id_col] == F.col("_id"))
    bounds = [
        f(name).alias(f"{name}_{end}")
        for name in dimensions
        for end, f in (("min", F.min), ("max", F.max))
    ]
    return rows.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("rows"), *bounds)
