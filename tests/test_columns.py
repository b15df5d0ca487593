from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shopledger.config import REGION_NAMES, AnalysisConfig
from shopledger.functions import columns as C


def _one(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema).select(column.alias("out"))
    return [row.out for row in df.collect()]


def test_region_names(spark):
    raw = [
        "Ivano-Frankivsk",
        "ivano  frankivsk",
        " odessa ",
        " LVIV\t",
        "Kyiv-City",
        "Chernihiv",
        None,
    ]
    named = C.normalize_label(F.col("x"), REGION_NAMES)
    assert _one(spark, named, [(r,) for r in raw], "x string") == [
        "Ivano-Frankivsk",
        "Ivano-Frankivsk",
        "Odesa",
        "Lviv",
        "Kyiv City",
        "Chernihiv",
        None,
    ]


def test_normalize_without_names_keeps_the_text(spark):
    assert _one(spark, C.normalize_label(F.col("x"), {}), [(" A",)], "x string") == [" A"]


def test_safe_ratio_never_fails(spark):
    rows = [(1, 4), (1, 0), (0, 0), (None, 2), (2, None)]
    assert _one(spark, C.safe_ratio(F.col("a"), F.col("b")), rows, "a int, b int") == [
        0.25,
        None,
        None,
        None,
        None,
    ]


def test_percent_rounds_half_away_from_zero(spark):
    rows = [(0.00125,), (-0.00125,), (0.5,)]
    assert _one(spark, C.percent(F.col("x")), rows, "x double") == [0.13, -0.13, 50.0]
    assert _one(spark, C.percent(F.col("x"), digits=None), rows, "x double")[0] == 0.125


def test_cutoff_is_the_end_of_the_day(spark):
    rows = [(datetime(2025, 12, 31, 23, 59, 59),), (datetime(2026, 1, 1),), (None,)]
    until = C.on_or_before(F.col("t"), date(2025, 12, 31))
    assert _one(spark, until, rows, "t timestamp_ntz") == [True, False, None]


def test_calendar_columns(spark):
    df = spark.createDataFrame([(datetime(2024, 2, 29, 23, 59),)], "t timestamp_ntz")
    row = df.select(*[c.alias(n) for n, c in C.calendar_columns(F.col("t")).items()]).first()
    assert tuple(row) == (date(2024, 2, 29), date(2024, 2, 1), 2024)


def test_latest_by_prefers_known_positions_then_time(spark):
    rows = [
        (1, 1, 5, "captured"),
        (1, 2, 1, "refunded"),
        (2, 1, 1, "failed"),
        (2, 1, 2, "captured"),
        (3, None, 9, "pending"),
        (3, 1, None, "captured"),
        (4, None, None, "only"),
        (5, 1, 1, "a"),
        (5, 1, 1, "b"),
    ]
    df = spark.createDataFrame(rows, "k int, seq int, at int, status string")
    latest = C.latest_by(F.col("status"), F.col("seq"), F.col("at"))
    found = dict(df.groupBy("k").agg(latest).collect())
    assert found == {1: "refunded", 2: "captured", 3: "captured", 4: "only", 5: "b"}


def test_cents_are_exact(spark):
    rows = [("9999999999999999.99",), ("-0.01",), ("0.10",), (None,)]
    df = spark.createDataFrame(rows, "x string").select(F.col("x").cast("decimal(18,2)").alias("x"))
    with_cents = df.withColumn("c", C.cents(F.col("x")))
    back = with_cents.withColumn("back", C.from_cents(F.col("c"))).collect()
    assert [r.c for r in back] == [999999999999999999, -1, 10, None]
    assert [r.back for r in back] == [r.x for r in back]


@pytest.mark.parametrize(
    ("orders", "profit", "expected"),
    [
        (10, 100, "Both met"),
        (11, 99, "Orders met, profit missed"),
        (9, 100, "Profit met, orders missed"),
        (9, 99, "Both missed"),
    ],
)
def test_target_status(spark, orders, profit, expected):
    status = C.target_status(F.col("o"), F.lit(10), F.col("p"), F.lit(100))
    assert _one(spark, status, [(orders, profit)], "o int, p int") == [expected]


def test_target_status_without_target(spark):
    status = C.target_status(F.col("o"), F.lit(None).cast("int"), F.col("p"), F.lit(1))
    assert _one(spark, status, [(5, 5)], "o int, p int") == ["Both missed"]


def test_growth_direction_with_missing_year(spark):
    rows = [(2, 1), (1, 1), (1, 2), (None, 1), (1, None)]
    direction = C.growth_direction(F.col("now"), F.col("before"))
    assert _one(spark, direction, rows, "now int, before int") == [
        "Growth",
        "Growth",
        "Decline",
        "Decline",
        "Decline",
    ]


def test_config_rejects_impossible_settings():
    with pytest.raises(ValueError):
        AnalysisConfig(window_start=date(2026, 1, 1))
    with pytest.raises(ValueError):
        AnalysisConfig(previous_year=2025)
    with pytest.raises(ValueError):
        AnalysisConfig(period_months=(13,))
