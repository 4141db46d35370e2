"""Deep pages and global ranks by range counts, against plain sorting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import brands, ordering, ranges
from shelfscope.operators.ranges import Key

SCHEMA = "id int, price double, name string, day date"


def rows_of(n, seed=3):
    draw = random.Random(seed)
    day = datetime.date(2024, 1, 1)
    return [
        (i, draw.choice([None, float("nan"), float("inf"), 1.5, 2.0, draw.random()]), draw.choice([None, "", "é", "z", "a" * draw.randrange(4)]),
         draw.choice([None, day + datetime.timedelta(draw.randrange(5))]))
        for i in range(n)
    ]


ORDERS = [
    [Key("id")],
    [Key("price", ascending=False), Key("id")],
    [Key("name", nulls_last=False), Key("day", False, False), Key("price"), Key("id", False)],
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(700), SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("keys", ORDERS)
def test_pages_are_slices_of_the_sorted_rows(table, keys):
    ids = [r["id"] for r in table.orderBy(*[k.order() for k in keys]).collect()]
    for n, size in ((1, 20), (7, 20), (35, 20), (36, 20), (3, 333), (2, 700)):
        got = ranges.page_at(table, n, keys, size, ranges=8, enough=30)
        assert [r["id"] for r in got.collect()] == ids[(n - 1) * size : n * size]


def test_a_deep_page_sorts_one_range(table):
    page = ranges.page_at(table, 30, ORDERS[0], 20, ranges=16, enough=60)
    kept = page._jdf.queryExecution().optimizedPlan().toString()
    assert "id" in kept.split("Filter")[1]
    # The rows that reach the sort: those of the ranges that hold the page.
    assert page.count() == 20 and ranges.page_at(table, 99, ORDERS[0], 20).count() == 0
    whole = ranges.ranges_of(table, ORDERS[0], 16)
    counts = [r["count"] for r in table.groupBy(whole.number()).count().collect()]
    assert len(counts) == 16 and max(counts) < 3 * 700 / 16


def test_equal_keys_and_no_rows(spark, table):
    same = spark.range(50).select(F.lit(1).alias("id"))
    assert ranges.page_at(same, 2, [Key("id")], 20, ranges=4, enough=5).count() == 20
    assert ranges.page_at(table.limit(0), 1, ORDERS[1]).count() == 0
    assert ranges.ranked(table.limit(0), {"r": ORDERS[1]}).count() == 0


def test_several_ranks(table):
    named = dict(zip(("a", "b", "c"), ORDERS))
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in ranges.ranked(table, named, ranges=8).collect()}
    for place, keys in enumerate(ORDERS):
        ids = [r["id"] for r in table.orderBy(*[k.order() for k in keys]).collect()]
        assert [got[i][place] for i in ids] == list(range(1, 701))


def test_ranks_of_very_many_brands(spark):
    table = spark.range(100_000).select(
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("brand"), (F.xxhash64("id") % 50).alias("reviews"),
        (F.xxhash64("id", F.lit(1)) % 1000 / 10.0).alias("positive_pct"), F.when(F.col("id") % 9 > 0, F.xxhash64("id", F.lit(2)) % 77).alias("avg_price"),
    )
    ranked = brands.brand_rankings(table)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_range" in plan.replace("#", "_") or "hashpartitioning(_range" in plan
    rows = [tuple(r) for r in ranked.collect()]
    for place, value in ((4, 1), (5, 2), (6, 3)):
        want = sorted(rows, key=lambda r: (r[value] is None, -(r[value] or 0), r[0]))
        assert [r[place] for r in want] == list(range(1, 100_001))


def test_sort_names_have_keys(spark):
    products = spark.createDataFrame([(1, 5.0, 2.0, "b"), (2, None, None, "a"), (3, 7.0, 2.0, None)], "id int, price double, discount_pct double, brand string")
    for by in ordering.SORTS:
        want = [r["id"] for r in products.orderBy(*ordering.sort_order(by, ["id"])).collect()]
        assert [r["id"] for r in ranges.page_at(products, 1, ordering.sort_keys(by, ["id"])).collect()] == want
