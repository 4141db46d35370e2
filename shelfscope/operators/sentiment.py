"""Lexicon sentiment over reviews and its aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.matching import computed_once, entries_of, with_hits
from shelfscope.lexicon import NEGATIVE, POSITIVE, Lexicon, unique

SENTIMENTS = ["positive", "negative", "neutral"]


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL for an empty whole."""
    return F.try_divide(part * 100.0, whole.cast("double"))


def unpack_reasons(packed: Column) -> Column:
    """``category:keyword, ...`` text to reason structs; NULL and blank mean none."""
    parts = F.filter(F.split(F.coalesce(packed, F.lit("")), ", "), lambda p: F.contains(p, F.lit(":")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.split_part(p, F.lit(":"), F.lit(1)).alias("category"),
            F.split_part(p, F.lit(":"), F.lit(2)).alias("keyword"),
        ),
    )


def score_sentiment(
    reviews: DataFrame,
    positive: Lexicon = POSITIVE,
    negative: Lexicon = NEGATIVE,
    max_reasons: int | None = 3,
) -> DataFrame:
    """Reviews with sentiment, scores and reasons, all review columns being kept.

    A lexicon entry counts once per review in whose text it is found; a keyword listed in two
    categories counts twice. The higher score gives the sentiment, equality is neutral. Reasons are
    the first ``max_reasons`` entries in lexicon order (None keeps them all). Narrow: no shuffle.
    """
    keywords = unique([*positive.keywords, *negative.keywords])
    return score_hits(with_hits(reviews, keywords), keywords, positive, negative, max_reasons).drop("_hits")


def score_hits(
    rows: DataFrame, keywords: Sequence[str], positive: Lexicon, negative: Lexicon, max_reasons: int | None = 3
) -> DataFrame:
    """`score_sentiment` of rows whose ``_hits`` among ``keywords`` (of both lexicons at least) are known."""
    scored = computed_once(rows, _pos=entries_of(keywords, positive), _neg=entries_of(keywords, negative))
    pos, neg = F.size("_pos"), F.size("_neg")

    def reasons(entries: str) -> Column:
        return F.col(entries) if max_reasons is None else F.slice(entries, 1, max_reasons)

    sentiment = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    return scored.withColumns(
        {
            "sentiment": sentiment,
            "positive_score": pos,
            "negative_score": neg,
            "positive_reasons": reasons("_pos"),
            "negative_reasons": reasons("_neg"),
        }
    ).drop("_pos", "_neg")


def sentiment_counts(scored: DataFrame) -> DataFrame:
    """Rows and share of each sentiment that occurs; three counters, one row shuffled per task."""
    counted = scored.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS],
    )
    cells = F.array(*[F.struct(F.lit(s).alias("sentiment"), F.col(s).alias("n")) for s in SENTIMENTS])
    return (
        counted.select("total", F.inline(cells))
        .filter("n > 0")
        .select("sentiment", "n", pct(F.col("n"), F.col("total")).alias("pct"))
        .orderBy(F.desc("n"), "sentiment")
    )


def _by_brand(scored: DataFrame) -> DataFrame:
    return (
        scored.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(
            *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS],
            F.count("*").alias("total"),
        )
    )


def brand_sentiment_matrix(scored: DataFrame, n: int = 10) -> DataFrame:
    """Sentiment counts of the n brands with most reviews."""
    return _by_brand(scored).orderBy(F.desc("total"), "brand").limit(n)


def brand_positive_ratio(scored: DataFrame, n: int = 15) -> DataFrame:
    """Brands with the highest share of positive reviews."""
    return (
        _by_brand(scored)
        .select(
            "brand",
            F.col("total").alias("reviews"),
            pct(F.col("positive"), F.col("total")).alias("positive_pct"),
        )
        .orderBy(F.desc("positive_pct"), "brand")
        .limit(n)
    )


def product_sentiment(scored: DataFrame) -> DataFrame:
    """Review count, sentiment shares and mean scores of every product, in one aggregation."""
    shares = [
        pct(F.count_if(F.col("sentiment") == s), F.count("*")).alias(f"{s}_pct") for s in SENTIMENTS
    ]
    return (
        scored.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.count("*").alias("total"),
            *shares,
            F.avg("positive_score").alias("avg_pos"),
            F.avg("negative_score").alias("avg_neg"),
        )
    )


def score_density(scored: DataFrame) -> DataFrame:
    """Reviews per (positive score, negative score, sentiment): the score scatter, bounded by the
    lexicon sizes instead of one dot per review."""
    return scored.groupBy("positive_score", "negative_score", "sentiment").agg(F.count("*").alias("n"))
