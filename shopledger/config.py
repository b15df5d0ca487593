"""Dates, periods and label tables the analysis is parametrised with."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta

# Cleaned spelling of a shipping region -> canonical region name.
REGION_NAMES: dict[str, str] = {
    "dnipropetrovsk": "Dnipropetrovsk",
    "dnipropetrovska": "Dnipropetrovsk",
    "ivano frankivsk": "Ivano-Frankivsk",
    "kharkiv": "Kharkiv",
    "kyiv": "Kyiv",
    "kyiv city": "Kyiv City",
    "lviv": "Lviv",
    "odesa": "Odesa",
    "odessa": "Odesa",
    "poltava": "Poltava",
    "vinnytsia": "Vinnytsia",
    "zaporizhia": "Zaporizhzhia",
    "zaporizhzhia": "Zaporizhzhia",
}

# Labels for orders whose customer has no acquisition channel.
GUEST_LABEL = "Guest checkout"
UNKNOWN_CHANNEL_LABEL = "Unknown acquisition channel"


@dataclass(frozen=True)
class AnalysisConfig:
    """One analysis: which orders enter the mart and which two years are compared.

    ``cutoff`` is the last day whose deliveries, payments and return requests
    count. ``period_months`` are the calendar months of the year-over-year
    comparison; monthly reports cover whole years.
    """

    window_start: date = date(2024, 1, 1)
    window_end: date = date(2025, 12, 31)
    cutoff: date = date(2025, 12, 31)
    previous_year: int = 2024
    current_year: int = 2025
    period_months: tuple[int, ...] = (10, 11)
    region_names: Mapping[str, str] = field(default_factory=lambda: dict(REGION_NAMES))
    guest_label: str = GUEST_LABEL
    unknown_channel_label: str = UNKNOWN_CHANNEL_LABEL

    def __post_init__(self) -> None:
        if self.window_start > self.window_end:
            raise ValueError("window_start is after window_end")
        if self.previous_year >= self.current_year:
            raise ValueError("previous_year must be before current_year")
        if not self.period_months or not all(1 <= m <= 12 for m in self.period_months):
            raise ValueError("period_months must be calendar months 1..12")

    @property
    def years(self) -> tuple[int, int]:
        return (self.previous_year, self.current_year)

    @property
    def first_period_month(self) -> int:
        return min(self.period_months)

    def period_starts(self, *years: int) -> list[date]:
        """First day of every comparison month in the given years."""
        return [date(y, m, 1) for y in years for m in sorted(self.period_months)]

    def year_starts(self, *years: int) -> list[date]:
        """First day of every month in the given years."""
        return [date(y, m, 1) for y in years for m in range(1, 13)]


def day_after(day: date) -> date:
    return day + timedelta(days=1)
