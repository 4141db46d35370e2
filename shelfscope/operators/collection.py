"""Link clean-up, de-duplication and recency of collected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.ordering import first_n_per_group


def absolute_link(link: Column, host: str | None) -> Column:
    """Link with the host in front when it is relative; unchanged without a host."""
    if host is None:
        return link
    return F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(host), link))


def with_links(products: DataFrame, host: str | None) -> DataFrame:
    """Products that have a link, made absolute."""
    linked = products.filter(F.col("link").isNotNull() & (F.col("link") != ""))
    return linked.withColumn("link", absolute_link(F.col("link"), host))


def dedup_by_link(
    products: DataFrame, key: Sequence[str], host: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """First row per link (per ``by`` and link) in key order; rows without a link are dropped."""
    first = first_n_per_group(with_links(products, host), [*by, "link"], list(key), 1, "_rn")
    return first.drop("_rn")


def recent_reviews(
    reviews: DataFrame,
    as_of: Column,
    days: int = 90,
    strict: bool = False,
    order: Sequence[str] = ("page_number", "pos"),
) -> DataFrame:
    """Reviews not older than ``days`` before ``as_of``; a missing date counts as recent.

    ``strict`` stops a product at its first older review in page order, which differs only when
    reviews are not newest first. The stop position is an aggregate joined back, not a running
    window, so a product with very many reviews is not gathered in one task.
    """
    cutoff = F.timestamp_add("DAY", F.lit(-days), as_of)
    old = F.coalesce(F.col("date") < cutoff, F.lit(False))
    if not strict:
        return reviews.filter(~old)
    stops = (
        reviews.filter(old)
        .groupBy(F.col("product_id").alias("_product"))
        .agg(F.min(F.struct(*order)).alias("_stop"))
    )
    joined = reviews.join(stops, F.col("product_id").eqNullSafe(F.col("_product")), "left")
    before = F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))
    return joined.filter(before).select(*reviews.columns)
