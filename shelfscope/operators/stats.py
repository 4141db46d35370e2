"""Catalogue and review statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.values import text_or_nan
from shelfscope.operators.ordering import first_key
from shelfscope.operators.quantiles import cells_of, exact_quantiles
from shelfscope.operators.sentiment import pct

PREMIUM_PRICE = 70000
ACTIVE_DISCOUNT = 25


def catalogue_kpis(products: DataFrame) -> DataFrame:
    """Products, distinct brands, mean price and mean discount; missing values are skipped."""
    return products.agg(
        F.count("*").alias("products"),
        F.countDistinct("brand").alias("brands"),
        F.avg("price").alias("avg_price"),
        F.avg("discount_pct").alias("avg_discount"),
    )


def search_summary(filtered: DataFrame) -> DataFrame:
    """Rows, mean price and mean discount of a filtered catalogue."""
    return filtered.agg(
        F.count("*").alias("products"),
        F.avg("price").alias("avg_price"),
        F.avg("discount_pct").alias("avg_discount"),
    )


def price_stats(products: DataFrame) -> DataFrame:
    """Mean, least and greatest price, and whole-number slider bounds with their defaults."""
    return products.agg(
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.coalesce(F.min("price").cast("long"), F.lit(0)).alias("slider_min"),
        F.coalesce(F.max("price").cast("long"), F.lit(1000000)).alias("slider_max"),
    )


def price_positioning(
    products: DataFrame, premium: float = PREMIUM_PRICE, active: float = ACTIVE_DISCOUNT
) -> DataFrame:
    """Mean and exact median price, mean discount, and the two strategy flags."""
    cells = cells_of(products, ["price", "discount_pct"])
    median = exact_quantiles(cells.filter("column = 'price'"), [0.5]).select("value")
    mean = lambda c: F.avg(F.when(F.col("column") == c, F.col("value")))
    return (
        cells.agg(mean("price").alias("avg_price"), mean("discount_pct").alias("avg_discount"))
        .withColumn("median_price", median.scalar())
        .select(
            "avg_price",
            "median_price",
            "avg_discount",
            F.when(F.col("avg_price") > premium, "premium").otherwise("mid_low").alias("tier"),
            F.when(F.col("avg_discount") > active, "active").otherwise("selective").alias("policy"),
        )
    )


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max of numeric columns."""
    cells = cells_of(df, columns)
    moments = (
        cells.groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = (
        exact_quantiles(cells, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
               for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    )
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def _top_by_brand(df: DataFrame, value: Column, name: str, n: int) -> DataFrame:
    return (
        df.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(value.alias(name))
        .orderBy(F.col(name).desc_nulls_last(), "brand")
        .limit(n)
    )


def brand_counts(products: DataFrame, n: int = 15) -> DataFrame:
    return _top_by_brand(products, F.count("*"), "products", n)


def brand_avg_price(products: DataFrame, n: int = 15) -> DataFrame:
    return _top_by_brand(products, F.avg("price"), "avg_price", n)


def brand_avg_discount(products: DataFrame, n: int = 10) -> DataFrame:
    return _top_by_brand(products, F.avg("discount_pct"), "avg_discount", n)


def brand_review_counts(reviews: DataFrame, n: int = 10) -> DataFrame:
    return _top_by_brand(reviews, F.count("*"), "reviews", n)


def top_brand_list(products: DataFrame, n: int = 5) -> DataFrame:
    """Names of the n brands with most products, comma-joined in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct(-F.col("products"), F.col("brand"))))
    names = F.transform(ranked, lambda r: r["brand"])
    return brand_counts(products, n).agg(F.array_join(names, ", ").alias("text"))


def product_directory(reviews: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per product: brand of its first review, and review count."""
    return (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.min_by("brand", first_key(key)).alias("brand"), F.count("*").alias("reviews"))
    )


def top_reviewed_products(reviews: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    return product_directory(reviews, key).orderBy(F.desc("reviews"), "product_id").limit(n)


def review_length(reviews: DataFrame, compat_nan: bool = False) -> DataFrame:
    """Mean number of characters per review."""
    return reviews.agg(F.avg(F.length(text_or_nan(F.col("text"), compat_nan))).alias("avg_chars"))


def avg_review_pages(reviews: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Mean over products of the last review page; reviews per catalogue product where no review
    has a page number."""
    last = (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.max("page_number").alias("pages"), F.count("*").alias("n"))
    )
    paged = last.agg(F.avg("pages").alias("value"))
    if products is None:
        return paged
    density = F.try_divide(
        reviews.agg(F.count("*")).scalar().cast("double"), products.agg(F.count("*")).scalar()
    )
    return paged.select(F.coalesce("value", density).alias("value"))


def page_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per page number, in page order."""
    return (
        reviews.filter(F.col("page_number").isNotNull())
        .groupBy("page_number")
        .agg(F.count("*").alias("reviews"))
        .orderBy("page_number")
    )


def crawl_brand_stats(reviews: DataFrame, n: int = 10) -> DataFrame:
    """Per brand: distinct products and reviews with text, most reviews first."""
    return (
        reviews.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(F.countDistinct("product_id").alias("products"), F.count("text").alias("reviews"))
        .orderBy(F.desc("reviews"), "brand")
        .limit(n)
    )


def image_share() -> Column:
    """Percent of rows with an image; a missing flag counts as no image."""
    return pct(F.count_if(F.col("has_image") == "Y"), F.count("*"))


def image_ratio(reviews: DataFrame, by: str | None = None) -> DataFrame:
    if by is None:
        return reviews.agg(image_share().alias("image_pct"))
    return reviews.filter(F.col(by).isNotNull()).groupBy(by).agg(image_share().alias("image_pct"))


def top_image_brands(reviews: DataFrame, n: int = 5) -> DataFrame:
    return image_ratio(reviews, "brand").orderBy(F.desc("image_pct"), "brand").limit(n)


def helpful_avg(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.avg("helpful_count").alias("value"))


def distinct_reviewed_products(reviews: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct products and brands in the reviews; the sketch is an option, never the default."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return reviews.agg(distinct("product_id").alias("products"), distinct("brand").alias("brands"))
