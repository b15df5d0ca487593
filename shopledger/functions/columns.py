"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.window import WindowSpec

from shopledger.config import day_after

# Amounts are exact everywhere, so results do not depend on the order of tasks.
# Rows are summed as whole cents in BIGINT, which aggregates several times faster
# than wide decimals and shuffles in 8 bytes. A product or sum beyond BIGINT (over 92
# quadrillion) raises, as ANSI arithmetic is required; MONEY holds every sum that
# does not, TOTAL the sums over all orders or products.
MONEY = T.DecimalType(20, 2)
TOTAL = T.DecimalType(38, 2)

# Code points with the Unicode White_Space property.
WHITE_SPACE_CODES = (
    *range(0x0009, 0x000E),
    0x0020,
    0x0085,
    0x00A0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
WHITE_SPACE = "".join(map(chr, WHITE_SPACE_CODES))


def money(amount: Column) -> Column:
    return amount.cast(MONEY)


def total(amount: Column) -> Column:
    return amount.cast(TOTAL)


def cents(amount: Column) -> Column:
    """A DECIMAL(18,2) amount as whole cents, exactly."""
    return (amount * F.lit(100)).cast("bigint")


def from_cents(whole_cents: Column, kind: T.DecimalType = MONEY) -> Column:
    """Whole cents back as a two-digit decimal, exactly."""
    return (whole_cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(kind)


# --- conditional aggregates -------------------------------------------------


def count_where(condition: Column) -> Column:
    """Rows meeting the condition; unknown counts as not met."""
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over the rows meeting the condition, 0 for the others."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def latest_by(value: Column, *order_keys: Column) -> Column:
    """The value of the last row by ``order_keys``; ties go to the greatest value.

    NULL keys sort first, so a row with a known position always wins.
    """
    return F.max_by(value, F.struct(*order_keys, value))


# --- ratios -----------------------------------------------------------------


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, NULL when whole is 0 or either is NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(ratio: Column, digits: int | None = 2) -> Column:
    """A fraction as percent, rounded half away from zero unless digits is None."""
    scaled = F.lit(100) * ratio
    return scaled if digits is None else F.round(scaled, digits)


def relative_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous; the difference is taken exactly."""
    return safe_ratio(current - previous, previous)


def change_on_previous_row(value: Column, window: WindowSpec) -> Column:
    return relative_change(value, F.lag(value).over(window))


def step_from_previous_row(value: Column, window: WindowSpec) -> Column:
    return value - F.lag(value).over(window)


def share_of_total(value: Column, window: WindowSpec) -> Column:
    return safe_ratio(value, F.sum(value).over(window))


# --- dates ------------------------------------------------------------------


def on_or_before(timestamp: Column, day: date) -> Column:
    """DATE(timestamp) <= day, kept as a range on the raw column for the scan."""
    return timestamp < F.lit(day_after(day))


def within_days(timestamp: Column, first: date, last: date) -> Column:
    """DATE(timestamp) between two days, both inclusive, as a raw-column range."""
    return (timestamp >= F.lit(first)) & on_or_before(timestamp, last)


def calendar_columns(timestamp: Column) -> dict[str, Column]:
    """Day, first day of the month and year of a timestamp."""
    day = F.to_date(timestamp)
    return {
        "order_date": day,
        "order_month": F.trunc(day, "MM"),
        "order_year": F.year(day),
    }


def month_in(month_start: Column, months: Iterable[date]) -> Column:
    """Membership in a list of month starts; prunes a table laid out by month."""
    return month_start.isin([F.lit(m) for m in months])


# --- labels and flags -------------------------------------------------------


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def clean_label(text: Column) -> Column:
    """Runs of hyphens and blanks become one space; trimmed, lower case."""
    spaced = F.regexp_replace(text, r"[-\t\n\f\r ]+", " ")
    return F.lower(F.trim(spaced, F.lit(WHITE_SPACE)))


def normalize_label(text: Column, names: Mapping[str, str]) -> Column:
    """Canonical name of a cleaned label; unknown labels stay as they came."""
    if not names:
        return text
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, clean_label(text)), text)


def target_attainment(actual: Column, target: Column) -> Column:
    """The fraction of a target that was reached; NULL without a target or with one of 0."""
    return safe_ratio(actual, target)


def target_status(
    orders: Column, orders_target: Column, profit: Column, profit_target: Column
) -> Column:
    """Which of the two targets were met; exactly on target counts as met.

    A missing target makes every comparison unknown and ends in 'Both missed'.
    """
    orders_met, orders_missed = orders >= orders_target, orders < orders_target
    profit_met, profit_missed = profit >= profit_target, profit < profit_target
    return (
        F.when(orders_met & profit_met, "Both met")
        .when(orders_met & profit_missed, "Orders met, profit missed")
        .when(orders_missed & profit_met, "Profit met, orders missed")
        .otherwise("Both missed")
    )


def growth_direction(current: Column, previous: Column) -> Column:
    """'Growth' when current >= previous, else (or when one is missing) 'Decline'."""
    return F.when(current >= previous, "Growth").otherwise("Decline")
