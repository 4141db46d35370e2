"""Catalogue search and filters. Plain predicates, so Catalyst can push them into the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.functions.matching import contains_any
from shelfscope.lexicon import COLOR, STYLE_FULL, Lexicon
from shelfscope.operators.ordering import first_key


def term_condition(df: DataFrame, term: str, literal: bool = False) -> Column:
    """Name or brand matches the term: a case-insensitive regular expression, or literal text.
    Missing values do not match; without name and brand columns nothing matches."""
    pattern = "(?iu)" + (re.escape(term) if literal else term)
    found = F.lit(False)
    for column in ("name", "brand"):
        if column in df.columns:
            found = found | F.coalesce(F.rlike(F.col(column), F.lit(pattern)), F.lit(False))
    return found


def search_keyword(products: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
    """Products whose name or brand matches; a blank term keeps everything."""
    return products.filter(term_condition(products, term, literal)) if term else products


def price_band_filter(products: DataFrame, band: str | int | None) -> DataFrame:
    """One price band by label or position: lower bound excluded, upper bound included. The lowest
    band has no lower bound, so it holds zero and negative prices too."""
    if band is None or band == fv.ALL_OPTION:
        return products
    i = fv.PRICE_LABELS.index(band) if isinstance(band, str) else band
    price = F.col("price")
    if i > 0:
        products = products.filter(price > fv.PRICE_EDGES[i])
    if i < len(fv.PRICE_LABELS) - 1:
        products = products.filter(price <= fv.PRICE_EDGES[i + 1])
    return products


def price_range_filter(
    products: DataFrame, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """lo <= price <= hi; an active filter removes missing prices."""
    if lo is not None:
        products = products.filter(F.col("price") >= lo)
    if hi is not None:
        products = products.filter(F.col("price") <= hi)
    return products


def min_discount_filter(products: DataFrame, m: float | None) -> DataFrame:
    """discount >= m; missing discounts are removed even when m is 0."""
    return products if m is None else products.filter(F.col("discount_pct") >= m)


def discounted_only(products: DataFrame) -> DataFrame:
    return products.filter(F.col("discount_pct") > 0)


def brand_in_filter(
    products: DataFrame, brands: str | Sequence[str] | None, empty_keeps_all: bool = True
) -> DataFrame:
    """Brand equals one or is in a list. An empty list keeps everything or, where the selection is
    compulsory, nothing."""
    if brands is None or brands == fv.ALL_OPTION:
        return products
    if isinstance(brands, str):
        return products.filter(F.col("brand") == brands)
    if not brands:
        return products if empty_keeps_all else products.filter(F.lit(False))
    return products.filter(F.col("brand").isin(list(brands)))


def default_brand_selection(products: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The n brands met first in key order."""
    first = F.min(first_key(key))
    return (
        products.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(first.alias("_first"))
        .orderBy("_first")
        .limit(n)
        .select("brand")
    )


def high_discount_count(products: DataFrame, m: float = 30) -> DataFrame:
    """Number of products with a discount strictly above m."""
    return products.agg(F.count_if(F.col("discount_pct") > m).alias("n"))


def detail_search(
    products: DataFrame,
    term: str | None = None,
    lo: float | None = None,
    hi: float | None = None,
    brands: Sequence[str] | None = None,
    categories: Sequence[str] = (),
    colors: Sequence[str] = (),
    patterns: Sequence[str] = (),
    color_words: Lexicon = COLOR,
    pattern_words: Lexicon = STYLE_FULL,
) -> DataFrame:
    """All conditions of the detailed search together. Colours and patterns are lexicon categories
    (a name of no category is taken as a keyword), categories are words; within one list any match
    is enough. A price bound of 0 means no bound, as in the search form."""
    text = F.coalesce(*[F.col(c) for c in ("style_text", "name", "text") if c in products.columns])
    out = brand_in_filter(search_keyword(products, term), brands)
    out = price_range_filter(out, lo or None, hi or None)
    for wanted, lexicon in (
        (categories, Lexicon(())), (colors, color_words), (patterns, pattern_words),
    ):
        if wanted:
            known = dict(lexicon.categories)
            words = [k for name in wanted for k in known.get(name, (name,))]
            out = out.filter(contains_any(text, words))
    return out


def batch_keyword_search(
    products: DataFrame, terms: Sequence[str], literal: bool = False
) -> DataFrame:
    """Products matching each of several terms, tagged with the term; a product appears once per
    term it matches. The terms are a parameter list, so each row carries its own matches and no
    join is needed."""
    terms = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
    if not terms:
        return products.filter(F.lit(False)).withColumn("search_term", F.lit(""))
    matches = F.array_compact(
        F.array(*[F.when(term_condition(products, t, literal), F.lit(t)) for t in terms])
    )
    tagged = products.drop("search_term").withColumn("search_term", F.explode(matches))
    return tagged.select("search_term", *[c for c in tagged.columns if c != "search_term"])


def brand_options(products: DataFrame) -> DataFrame:
    """Distinct brands in order (missing ones dropped)."""
    return products.select("brand").filter(F.col("brand").isNotNull()).distinct().orderBy("brand")


def brand_name_text(products: DataFrame) -> DataFrame:
    """Products with text = brand, a space and name."""
    return products.withColumn("text", F.concat(F.col("brand"), F.lit(" "), F.col("name")))


def display_columns(
    products: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, n: int = 100
) -> DataFrame:
    """The display columns that exist, first n rows in key order."""
    wanted = [c for c in (columns or fv.DISPLAY_COLUMNS) if c in products.columns]
    return products.orderBy(*key).limit(n).select(*wanted)


def preview(df: DataFrame, key: Sequence[str], n: int = 20) -> DataFrame:
    return df.orderBy(*key).limit(n)
