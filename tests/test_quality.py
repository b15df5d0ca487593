from shopledger.functions.frames import Relationship, duplicate_keys, orphans
from shopledger.operators import quality
from tests.tiny_shop import item, order, payment, returned, shop


def test_null_keys_count_as_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert duplicate_keys({"t.k": (df, "k")}).collect() == [("t.k", 2)]


def test_orphans_with_null_and_repeated_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "pk int")
    required = Relationship("required", child, "fk", parent, "pk")
    optional = Relationship("optional", child, "fk", parent, "pk", optional=True)
    nothing = Relationship("nothing", child.limit(0), "fk", parent, "pk")
    assert dict(orphans([required, optional, nothing]).collect()) == {
        "required": 4,
        "optional": 3,
        "nothing": 0,
    }


def test_relationships_of_a_shop(spark):
    tables = shop(
        spark,
        orders=[order(1, customer_id=None), order(2, customer_id=99), order(3)],
        customers=[{"customer_id": 1}],
        products=[{"product_id": 7}],
        order_items=[item(1, 1), item(2, None), item(3, 3, product_id=8)],
        payments=[payment(1), payment(50)],
        returns=[returned(1, 1), returned(77, 1), returned(None, 1)],
    )
    assert dict(quality.broken_relationships(tables).collect()) == {
        "orders -> customers": 1,
        "order_items -> orders": 1,
        "order_items -> products": 1,
        "payments -> orders": 1,
        "returns -> order_items": 2,
    }
    assert dict(quality.key_duplicates(tables).collect())["orders.order_id"] == 0
    assert dict(quality.table_sizes(tables).collect())["monthly_targets"] == 0


def test_empty_orders(spark):
    row = quality.missing_values(shop(spark).orders).first()
    assert tuple(row) == (0, 0, None, 0, 0)


def test_unknown_values_are_not_invalid(spark):
    items = shop(
        spark,
        order_items=[
            item(1, 1, quantity=None),
            item(2, 1, quantity=0),
            item(3, 1, unit_price_uah=-1, unit_cost_uah=-1, item_discount_uah=-5),
            item(4, 1, item_discount_uah="100.01"),
            item(5, 1, item_discount_uah=100),
        ],
    ).order_items
    assert quality.invalid_items(items).first().asDict() == {
        "total_order_items": 5,
        "invalid_quantity": 1,
        "negative_price": 1,
        "negative_cost": 1,
        "negative_discount": 1,
        "discount_above_item_value": 1,
    }
