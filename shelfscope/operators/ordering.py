"""Sorting, paging and top-k.

Row order does not exist in a DataFrame, so every function that means "first" takes a key that
orders rows totally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.operators.ranges import Key
from shelfscope.session import stored

SORTS = {
    "price_asc": ("price", True),
    "price_desc": ("price", False),
    "discount_desc": ("discount_pct", False),
    "brand": ("brand", True),
}


def sort_order(by: str, key: Sequence[str]) -> list[Column]:
    """Sort columns for a sort name or its display label, missing values last in every mode."""
    column, ascending = SORTS[fv.SORT_LABELS.get(by, by)]
    col = F.col(column)
    return [col.asc_nulls_last() if ascending else col.desc_nulls_last(), *map(F.col, key)]


def sort_keys(by: str, key: Sequence[str]) -> list[Key]:
    """The same order for `ranges.page_at` and `ranges.ranked`."""
    column, ascending = SORTS[fv.SORT_LABELS.get(by, by)]
    return [Key(column, ascending), *[Key(k, nulls_last=False) for k in key]]


def first_key(key: Sequence[str]) -> Column:
    """One comparable column for a key; a plain column where possible, as it aggregates faster."""
    return F.col(key[0]) if len(key) == 1 else F.struct(*key)


def sort_products(products: DataFrame, by: str, key: Sequence[str]) -> DataFrame:
    """Range-partitioned sort. The key columns break ties, which also lets the range partitioner
    split a price or brand shared by very many rows."""
    return products.orderBy(*sort_order(by, key))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in a global order, without pulling them through one task.

    The sorted rows are written to the shared folder. Files follow the order, and each row knows its
    place in its file, so a row's number needs one count per file. Writes when called.
    """
    ordered = stored(df.orderBy(*order), "ordered").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index")
    )
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    counts = ordered.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(part, "_file")) - F.col("_rows")
    offsets = counts.select("_file", before.alias("_before"))
    return (
        ordered.join(F.broadcast(offsets), "_file")
        .withColumn(name, F.col("_before") + F.col("_index") + 1)
        .drop("_file", "_index", "_before")
    )


def page(df: DataFrame, n: int, order: Sequence[Column], size: int = 20) -> DataFrame:
    """Rows of page n (from 1) in a total order: a top-k with offset, whatever the depth.

    Every task sends the rows up to the page's end, so the cost follows the depth asked for. A deep page
    comes from `ranges.page_at`; to walk through many, number the rows once (`numbered`).
    """
    return df.orderBy(*order).offset((n - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    """Number of pages."""
    return df.agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("pages"))


def first_n_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rn",
    few_groups: bool = False, salts: int = 64,
) -> DataFrame:
    """First n rows of every group, numbered.

    Groups are cut before the shuffle by the group limit of the window, so a task sends n rows of a
    group at most. With ``few_groups`` (few groups hold all rows, whatever the table's size) those
    still add up to tasks x n rows in one task; there the groups are first cut within salts of the
    order columns (given by name), and the last task of a group gets salts x n rows.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    if few_groups:
        salted = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
            .withColumn("_rn", F.row_number().over(salted))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def top_discount(products: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """Largest discounts; missing ones only fill places left over."""
    return products.orderBy(F.col("discount_pct").desc_nulls_last(), *key).limit(n)


def samples_per_sentiment(scored: DataFrame, key: Sequence[str], n: int = 3) -> DataFrame:
    """First n reviews of each sentiment."""
    return first_n_per_group(scored, ["sentiment"], list(key), n, few_groups=True)


def priority_products(
    products: DataFrame, key: Sequence[str], brands: int = 30, n: int = 5
) -> DataFrame:
    """First n products belonging to the brands with most products. The brand list is a top-k, so
    its size is fixed by the parameter and it can be broadcast."""
    top = (
        products.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), "brand")
        .limit(brands)
        .select("brand")
    )
    return products.join(F.broadcast(top), "brand", "left_semi").orderBy(*key).limit(n)


def cap_per_product(
    reviews: DataFrame, order: Sequence[Column | str] = ("page_number", "pos"), n: int = 100
) -> DataFrame:
    """At most n reviews of a product, in page order (asked-for behaviour of the collection)."""
    known = reviews.filter(F.col("product_id").isNotNull())
    return first_n_per_group(known, ["product_id"], list(order), n, "_cap").drop("_cap")


def cap_catalogue(products: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """At most n products, in key order; apply after dedup_by_link."""
    return products.orderBy(*key).limit(n)
