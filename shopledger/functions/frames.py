"""DataFrame building blocks: table checks, skew-proof joins, year pairing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shopledger.functions.columns import count_where, month_in


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- table checks -----------------------------------------------------------


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table; the scans read no columns."""
    return union_all(
        [
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def duplicate_keys(keys: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(checked_key, duplicate_rows): rows minus distinct keys, NULLs as duplicates."""
    return union_all(
        [
            df.agg(
                (F.count("*") - F.count_distinct(F.col(key))).alias("duplicate_rows")
            ).select(F.lit(label).alias("checked_key"), "duplicate_rows")
            for label, (df, key) in keys.items()
        ]
    )


@dataclass(frozen=True)
class Relationship:
    """A foreign key to check. ``optional`` foreign keys may be NULL."""

    label: str
    child: DataFrame
    child_key: str
    parent: DataFrame
    parent_key: str
    optional: bool = False


def orphan_rows(relationship: Relationship) -> DataFrame:
    """(relationship, orphan_rows): child rows whose key no parent row has.

    The child is counted per key before the anti join, so a key held by a third
    of the rows crosses the shuffle as one row per map task, and the join reuses
    the partitioning of that count. A NULL key never matches and so counts,
    unless the key is optional.
    """
    r = relationship
    child = r.child.select(F.col(r.child_key).alias("key"))
    if r.optional:
        child = child.filter(F.col("key").isNotNull())
    per_key = child.groupBy("key").agg(F.count("*").alias("rows"))
    known = r.parent.select(F.col(r.parent_key).alias("key")).distinct()
    return (
        per_key.join(known, "key", "left_anti")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
        .select(F.lit(r.label).alias("relationship"), "orphan_rows")
    )


def orphans(relationships: Sequence[Relationship]) -> DataFrame:
    return union_all([orphan_rows(r) for r in relationships])


def flag_counts(df: DataFrame, total: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row: the row count and, per rule, the rows meeting it. One scan."""
    return df.agg(
        F.count("*").alias(total),
        *[count_where(condition).alias(name) for name, condition in rules.items()],
    )


# --- joins ------------------------------------------------------------------


def left_join_spread(
    left: DataFrame, right: DataFrame, key: str, *spread_by: str
) -> DataFrame:
    """Left join on an id that may be NULL, or one value, for a third of the left rows.

    Hashing on the id alone would send all NULL rows to one task. The second
    join key fills NULLs from a hash of the ``spread_by`` columns, which scatters
    those rows; the first demands the real id, so they match nothing.

    The key pair also makes Spark shuffle both sides for this very join, even a
    right side already grouped by the id. That is wanted: AQE splits a hot key
    only between two fresh shuffles. (Comparing complements keeps the optimizer
    from folding the pair into one key where the id is known not to be NULL.) A
    small right side is broadcast as usual.
    """
    right_key = f"__{key}"
    renamed = right.withColumnRenamed(key, right_key)
    spread = F.coalesce(left[key], F.xxhash64(*[left[name] for name in spread_by]))
    return left.join(
        renamed,
        (left[key] == renamed[right_key])
        & (F.bitwise_not(spread) == F.bitwise_not(renamed[right_key])),
        "left",
    ).drop(right_key)


# --- cohorts and year pairing -----------------------------------------------------------


def first_event_cohort(
    events: DataFrame,
    entity: str,
    day: str,
    month: str,
    periods: Mapping[int, Sequence[date]],
) -> DataFrame:
    """(entity, first_day, period): each period an entity was active in, and its first day ever.

    ``periods`` maps a period to its month starts. One aggregation by entity,
    combined before the shuffle, gives both, so the events of one entity are
    never gathered nor joined back to themselves.
    """
    active = {p: F.bool_or(month_in(F.col(month), months)) for p, months in periods.items()}
    history = events.groupBy(entity).agg(
        F.min(day).alias("first_day"),
        *[was_active.alias(f"active_{p}") for p, was_active in active.items()],
    )
    seen = F.array(*[F.when(F.col(f"active_{p}"), F.lit(p)) for p in periods])
    return history.select(entity, "first_day", F.explode(F.array_compact(seen)).alias("period"))


def pivot_max(
    df: DataFrame, keys: Sequence[str], by: str, cells: Mapping[str, tuple[object, str]]
) -> DataFrame:
    """One row per key; each cell is the value of one column where ``by`` has a value.

    ``cells`` maps the output name to (value of ``by``, column to take).
    """
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(by) == F.lit(value), F.col(column))).alias(name)
            for name, (value, column) in cells.items()
        ]
    )


def pair_months(
    monthly: DataFrame, measures: Sequence[str], current_year: int, previous_year: int
) -> DataFrame:
    """Months of the current year beside the same month of the previous year.

    Input: one row per ``order_month``/``order_year``. Both years come out of
    one aggregation over one scan instead of a self join over two; a month
    missing in the previous year is kept with NULLs (``previous_*``), a month
    missing in the current year is dropped.
    """
    cells: dict[str, tuple[object, str]] = {"order_month": (current_year, "order_month")}
    for name in measures:
        cells[name] = (current_year, name)
        cells[f"previous_{name}"] = (previous_year, name)
    numbered = monthly.withColumn("month_number", F.month("order_month"))
    return pivot_max(numbered, ["month_number"], "order_year", cells).filter(
        F.col("order_month").isNotNull()
    )
