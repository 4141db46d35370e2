"""Whole analyses composed of operators: catalogue page, review dashboard, product report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from shelfscope import fixed_values as fv
from shelfscope.lexicon import IMPROVEMENT, NEGATIVE, POSITIVE, Lexicon
from shelfscope.operators import bins, brands, filters, insights, ordering, sentiment, stats, styles
from shelfscope.operators import trends as trend_ops
from shelfscope.sources.sinks import write_csv_bom
from shelfscope.sources.tables import read_reviews


@dataclass(frozen=True)
class ReviewWords:
    """Lexicons and word lists of the review analyses."""

    positive: Lexicon = POSITIVE
    negative: Lexicon = NEGATIVE
    improvement: Lexicon = IMPROVEMENT
    needs: Sequence[str] = tuple(fv.NEED_WORDS)
    stop_words: Sequence[str] = tuple(fv.STOP_WORDS)
    pattern: str = fv.THEME_PATTERN


@dataclass(frozen=True)
class CatalogueQuery:
    """Search form of the catalogue page."""

    key: Sequence[str] = field(default=("product_id", "link"))
    term: str | None = None
    band: str | int | None = None
    lo: float | None = None
    hi: float | None = None
    min_discount: float | None = None
    brands: str | Sequence[str] | None = None
    sort: str = "price_asc"
    page: int = 1
    page_size: int = 20


def search_catalogue(products: DataFrame, query: CatalogueQuery) -> DataFrame:
    """Filter chain of the search form, unsorted. One fused filter in the plan."""
    out = filters.search_keyword(products, query.term)
    out = filters.price_band_filter(out, query.band)
    out = filters.price_range_filter(out, query.lo, query.hi)
    out = filters.min_discount_filter(out, query.min_discount)
    return filters.brand_in_filter(out, query.brands)


def catalogue_page(products: DataFrame, query: CatalogueQuery) -> DataFrame:
    """Rows of the asked-for result page."""
    found = search_catalogue(products, query)
    order = ordering.sort_order(query.sort, query.key)
    return ordering.page(found, query.page, order, query.page_size)


def catalogue_report(products: DataFrame, query: CatalogueQuery) -> dict[str, DataFrame]:
    """Every table of the catalogue page over the filtered products, each a lazy DataFrame."""
    found = search_catalogue(products, query)
    discounted = filters.discounted_only(found)
    return {
        "page": catalogue_page(products, query),
        "pages": ordering.page_count(found, query.page_size),
        "kpis": stats.catalogue_kpis(found),
        "preview": filters.preview(found, query.key),
        "describe": stats.describe_numeric(found, ["price", "discount_pct"]),
        "price_histogram": bins.histogram(found, "price", 30),
        "discount_histogram": bins.histogram(discounted, "discount_pct", 20),
        "price_bands": bins.price_bands(found),
        "discount_bands": bins.discount_bands(found),
        "brand_counts": stats.brand_counts(found),
        "brand_avg_price": stats.brand_avg_price(found),
        "brand_avg_discount": stats.brand_avg_discount(found),
        "styles": styles.style_counts(found),
        "colors": styles.color_counts(found),
        "price_positioning": stats.price_positioning(found),
        "high_discount": filters.high_discount_count(found),
        "top_brand_list": stats.top_brand_list(found),
        "top_discount": ordering.top_discount(found, query.key),
        "top_value": styles.top_value(found, query.key),
    }


def product_report(
    reviews: DataFrame,
    key: Sequence[str],
    words: ReviewWords = ReviewWords(),
    product_ids: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Review analysis per product, for all products or the named ones, in one set of jobs."""
    if product_ids is not None:
        reviews = reviews.filter(reviews.product_id.isin(list(product_ids)))
    scored = sentiment.score_sentiment(reviews, words.positive, words.negative)
    themes = {"stop_words": words.stop_words, "pattern": words.pattern}
    return {
        "sentiment": sentiment.product_sentiment(scored),
        "themes": insights.product_themes(scored, **themes),
        "strengths": insights.top_strengths(scored, by="product_id"),
        "weaknesses": insights.top_weaknesses(scored, by="product_id"),
        "improvements": insights.improvement_topics(scored, words.improvement, by="product_id"),
        "improvement_examples": insights.topic_examples(
            scored, key, words.improvement, by="product_id"
        ),
        "needs": insights.customer_needs(reviews, key, words.needs, by="product_id"),
    }


def review_dashboard(
    reviews: DataFrame, scored: DataFrame, key: Sequence[str], words: ReviewWords = ReviewWords()
) -> dict[str, DataFrame]:
    """Every table of the review and insight pages. Pass stored or persisted scored reviews: each
    table is its own job."""
    themes = {"stop_words": words.stop_words, "pattern": words.pattern}
    return {
        "counts": sentiment.sentiment_counts(scored),
        "brand_matrix": sentiment.brand_sentiment_matrix(scored),
        "brand_positive": sentiment.brand_positive_ratio(scored),
        "density": sentiment.score_density(scored),
        "samples": ordering.samples_per_sentiment(scored, key),
        "positive_reasons": insights.top_reasons(scored, "positive"),
        "negative_reasons": insights.top_reasons(scored, "negative"),
        "positive_themes": insights.common_themes(scored, "positive", 10, **themes),
        "negative_themes": insights.common_themes(scored, "negative", 10, **themes),
        "strengths": insights.top_strengths(scored),
        "weaknesses": insights.top_weaknesses(scored),
        "improvements": insights.improvement_topics(scored, words.improvement),
        "improvement_examples": insights.topic_examples(scored, key, words.improvement),
        "needs": insights.customer_needs(scored, key, words.needs),
        "page_counts": stats.page_counts(reviews),
        "page_sentiment": trend_ops.page_sentiment(scored),
        "page_sentiment_fanout": trend_ops.page_sentiment_fanout(reviews, scored),
        "image_ratio": stats.image_ratio(reviews),
        "top_image_brands": stats.top_image_brands(reviews),
        "image_positive": trend_ops.image_product_positive_ratio(scored, reviews),
        "review_length": stats.review_length(reviews),
    }


def brand_dashboard(
    reviews: DataFrame,
    products: DataFrame,
    words: brands.BrandWords = brands.BrandWords(),
    scored: DataFrame | None = None,
    n: int = 5,
) -> dict[str, DataFrame]:
    """Brand reports, comparison and benchmark of the n most reviewed brands."""
    top = brands.top_brands(reviews, n)
    report = brands.brand_report(reviews, products, words, scored, top)
    comparison = brands.compare_brands(top, reviews, products, words, scored)
    return {
        "report": report,
        "suggestions": brands.marketing_suggestions(report),
        "comparison": comparison,
        "comparison_table": brands.comparison_table(comparison),
        "benchmark": brands.benchmark_brands(reviews, products, words, scored, n),
    }


def score_job(
    spark: SparkSession, reviews_paths: Sequence[str], out: str, csv: str | None = None,
    words: ReviewWords = ReviewWords(),
) -> DataFrame:
    """Batch job: read reviews, score them, store them as Parquet (and CSV), return the counts."""
    reviews = read_reviews(spark, reviews_paths)
    sentiment.score_sentiment(reviews, words.positive, words.negative).write.mode(
        "overwrite"
    ).parquet(out)
    stored = spark.read.parquet(out)
    if csv:
        write_csv_bom(stored.select(*fv.SENTIMENT_COLUMNS), csv, mode="overwrite")
    return sentiment.sentiment_counts(stored)
