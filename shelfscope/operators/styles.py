"""Style and colour keyword counts, and the value score of products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.matching import computed_once, entries_of, with_hits
from shelfscope.lexicon import COLOR, STYLE, STYLE_FULL, Lexicon


def keyword_hits_by_category(
    products: DataFrame, lexicon: Lexicon, keep_zero: bool = True, column: str | None = None
) -> DataFrame:
    """Per category, over its keywords, the number of products whose text holds the keyword: a
    product with two keywords of one category counts twice. Largest first."""
    column = column or ("style_text" if "style_text" in products.columns else "name")
    names = lexicon.names
    texts = with_hits(products.select(F.col(column).alias("text")), lexicon.keywords)
    counted = (
        texts.select(F.inline(entries_of(lexicon.keywords, lexicon)))
        .groupBy("category")
        .agg(F.count("*").alias("hits"))
        .agg(*[
            F.coalesce(F.max(F.when(F.col("category") == c, F.col("hits"))), F.lit(0)).alias(f"n{i}")
            for i, c in enumerate(names)
        ])
    )
    cells = [
        F.struct(F.lit(i).alias("cat_ord"), F.lit(c).alias("category"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(names)
    ]
    out = counted.select(F.inline(F.array(*cells)))
    if not keep_zero:
        out = out.filter("n > 0")
    return out.orderBy(F.desc("n"), "cat_ord").select("category", "n")


def style_counts(products: DataFrame, lexicon: Lexicon = STYLE) -> DataFrame:
    """Short style list; styles that do not occur are left out."""
    return keyword_hits_by_category(products, lexicon, keep_zero=False)


def style_counts_full(products: DataFrame, lexicon: Lexicon = STYLE_FULL) -> DataFrame:
    """Long style list; styles that do not occur are shown with 0."""
    return keyword_hits_by_category(products, lexicon)


def color_counts(products: DataFrame, lexicon: Lexicon = COLOR) -> DataFrame:
    return keyword_hits_by_category(products, lexicon)


def value_score(products: DataFrame) -> DataFrame:
    """Price scaled to 0..1 over all products, discount as a fraction, and
    score = discount / (price + 0.1). With a single price there is no scale, hence no score."""
    bounds = products.agg(F.struct(F.min("price").alias("lo"), F.max("price").alias("hi"))).scalar()
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    return (
        computed_once(products, _bounds=bounds)
        .withColumn("price_norm", F.try_divide(F.col("price") - lo, hi - lo))
        .withColumn("discount_norm", F.col("discount_pct") / 100)
        .withColumn("value_score", F.try_divide("discount_norm", F.col("price_norm") + 0.1))
        .drop("_bounds")
    )


def top_value(products: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """Best value scores; products without a score only fill places left over."""
    return value_score(products).orderBy(F.col("value_score").desc_nulls_last(), *key).limit(n)
