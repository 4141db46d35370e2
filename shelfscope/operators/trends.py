"""Review trends across reviews, pages and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.sentiment import SENTIMENTS, pct


def page_sentiment_fanout(reviews: DataFrame, scored: DataFrame) -> DataFrame:
    """Page by sentiment counts over reviews joined to scored reviews on product only.

    Each review meets every scored review of its product, so counts are inflated; that is the asked
    result. Both sides are counted per product before the join, which multiplies the counts instead
    of the rows: a product joins (its pages) x (three sentiments) at most. Missing product ids meet
    each other.
    """
    pages = (
        reviews.filter(F.col("page_number").isNotNull())
        .groupBy("product_id", "page_number")
        .agg(F.count("*").alias("rows"))
    )
    moods = scored.groupBy(F.col("product_id").alias("scored_product")).agg(
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]
    )
    return (
        pages.join(moods, F.col("product_id").eqNullSafe(F.col("scored_product")))
        .groupBy("page_number")
        .agg(*[F.sum(F.col("rows") * F.col(s)).alias(s) for s in SENTIMENTS])
        .orderBy("page_number")
    )


def page_sentiment(scored: DataFrame) -> DataFrame:
    """Page by sentiment counts, each review with its own sentiment."""
    return (
        scored.filter(F.col("page_number").isNotNull())
        .groupBy("page_number")
        .agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS])
        .orderBy("page_number")
    )


def image_product_positive_ratio(scored: DataFrame, pictured: DataFrame | None = None) -> DataFrame:
    """Positive share of the scored reviews whose product has any review with an image.

    Where scored reviews carry `has_image` themselves, one aggregate per product tells both. Where images
    are known of other reviews (``pictured``), each side is reduced to one row per product and both are
    added up by product, so no review row is joined and missing product ids meet each other.
    """
    scores = [F.col("sentiment").alias("sentiment"), F.lit(1).alias("scored")]
    if pictured is None:
        rows = scored.select("product_id", "has_image", *scores)
    else:
        others = pictured.select("product_id", "has_image", F.lit(None).cast("string").alias("sentiment"), F.lit(0).alias("scored"))
        rows = scored.select("product_id", F.lit(None).cast("string").alias("has_image"), *scores).unionAll(others)
    products = rows.groupBy("product_id").agg(
        F.sum("scored").alias("n"), F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("has_image") == "Y").alias("pictures"),
    )
    return products.filter(F.col("pictures") > 0).agg(pct(F.sum("positive"), F.sum("n")).alias("pct"))
