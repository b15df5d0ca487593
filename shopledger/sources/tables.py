"""The seven input tables: fixed schemas and where to read them from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_AMOUNT = T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_long, _int, _str, _ts = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()

# Timestamps are UTC wall-clock times, so calendar days never depend on the session.
SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=_long,
        customer_id=_long,
        order_ts=_ts,
        order_status=_str,
        order_channel=_str,
        device_type=_str,
        shipping_region=_str,
        shipping_city=_str,
        shipping_fee_uah=_AMOUNT,
        promised_delivery_ts=_ts,
        delivered_ts=_ts,
    ),
    "order_items": _schema(
        order_item_id=_long,
        order_id=_long,
        product_id=_long,
        quantity=_int,
        unit_price_uah=_AMOUNT,
        unit_cost_uah=_AMOUNT,
        item_discount_uah=_AMOUNT,
    ),
    "customers": _schema(
        customer_id=_long,
        acquisition_channel=_str,
        loyalty_tier=_str,
        home_region=_str,
        home_city=_str,
        birth_year=_int,
        signup_ts=_ts,
    ),
    "products": _schema(product_id=_long, category=_str),
    "payments": _schema(
        order_id=_long,
        payment_sequence=_int,
        payment_status=_str,
        payment_amount_uah=_AMOUNT,
        payment_ts=_ts,
    ),
    "returns": _schema(
        order_item_id=_long,
        order_id=_long,
        return_status=_str,
        returned_quantity=_int,
        refund_amount_uah=_AMOUNT,
        return_request_ts=_ts,
    ),
    "monthly_targets": _schema(
        month=_str,
        region=_str,
        orders_target=_long,
        gross_profit_target_uah=_AMOUNT,
    ),
}


class ShopTables:
    """The input tables of one shop, each opened on first use."""

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self._open = open_table

    @cached_property
    def orders(self) -> DataFrame:
        return self._open("orders")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._open("order_items")

    @cached_property
    def customers(self) -> DataFrame:
        return self._open("customers")

    @cached_property
    def products(self) -> DataFrame:
        return self._open("products")

    @cached_property
    def payments(self) -> DataFrame:
        return self._open("payments")

    @cached_property
    def returns(self) -> DataFrame:
        return self._open("returns")

    @cached_property
    def monthly_targets(self) -> DataFrame:
        return self._open("monthly_targets")

    def by_name(self) -> dict[str, DataFrame]:
        """All seven tables in the order reports list them."""
        return {name: getattr(self, name) for name in SCHEMAS}


def _as_stored(found: DataFrame, field: T.StructField, zone: str) -> Column:
    """A stored column in the type of the schema, with no value changed on the way.

    Equal types are left alone, so their filters reach the scan. A zoned timestamp becomes
    its UTC wall clock in whatever zone the session is. Any other value that the type cannot
    hold as it is (a third digit of an amount, a half piece) raises.
    """
    column, kind = found[field.name], found.schema[field.name].dataType
    if kind == field.dataType or isinstance(kind, T.NullType):
        return column.cast(field.dataType).alias(field.name)
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(kind, T.TimestampType):
        if zone == "UTC":
            return column.cast(field.dataType).alias(field.name)
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.unix_micros(column), epoch).alias(field.name)
    cast = column.try_cast(field.dataType)
    if isinstance(kind, T.NumericType):
        kept = column.isNull() | (cast.isNotNull() & (cast.try_cast(kind) == column))
    else:
        kept = column.isNull() | cast.isNotNull()
    problem = F.concat(
        F.lit(f"{field.name} does not fit {field.dataType.simpleString()}: "), column.cast("string")
    )
    return F.when(kept, cast).otherwise(F.raise_error(problem)).alias(field.name)


def read_table(
    spark: SparkSession, name: str, location: str, source_format: str = "parquet"
) -> DataFrame:
    """One input table with its fixed schema, from files or (``table``) the catalog.

    Text formats are read with the schema. Formats that carry their own types
    are read as stored; where the types differ, wider numbers and zoned timestamps
    are accepted and a value that would change raises.
    """
    schema = SCHEMAS[name]
    if source_format == "table":
        found = spark.table(location)
    elif source_format in ("csv", "json"):
        reader = spark.read.schema(schema)
        if source_format == "csv":
            reader = reader.option("header", True).option("enforceSchema", False)
        found = reader.format(source_format).load(location)
    else:
        found = spark.read.format(source_format).load(location)
    zone = spark.conf.get("spark.sql.session.timeZone")
    return found.select([_as_stored(found, f, zone) for f in schema])


def read_tables(
    spark: SparkSession, locations: Mapping[str, str], source_format: str = "parquet"
) -> ShopTables:
    """All seven tables; ``locations`` maps table name to path or catalog name."""
    missing = sorted(set(SCHEMAS) - set(locations))
    if missing:
        raise ValueError(f"no location for tables: {', '.join(missing)}")
    return ShopTables(lambda name: read_table(spark, name, locations[name], source_format))


def tables_under(root: str, source_format: str = "parquet") -> dict[str, str]:
    """Locations of the tables side by side in one folder, or (``table``) in one schema."""
    between = "." if source_format == "table" else "/"
    return {name: f"{root.rstrip('/')}{between}{name}" for name in SCHEMAS}
