"""Brand profiles: positioning, purchase factors, target groups, strengths, comparison.

All brands are handled in one job with the brand as group key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.functions.matching import computed_once, hit_weight, occurrence_hits, with_hits
from shelfscope.functions.values import percent_format
from shelfscope.lexicon import AGE, BODY, FACTOR, NEGATIVE, POSITION, POSITIVE, Lexicon, unique
from shelfscope.operators.insights import category_examples
from shelfscope.operators.ranges import Key, ranked
from shelfscope.operators.sentiment import pct, score_hits
from shelfscope.operators.stats import image_share
from shelfscope.operators.tally import (
    category_cells,
    distinct,
    flag_cells,
    hit_cells,
    mean,
    measure_cells,
    occurrence_scores,
    one,
    presences,
    profile,
    reason_cells,
    reasons,
    total,
    value_cells,
)
from shelfscope.session import stored

RANKS = {"rank_reviews": "reviews", "rank_positive": "positive_pct", "rank_price": "avg_price"}


@dataclass(frozen=True)
class BrandWords:
    """Lexicons and texts of the brand report."""

    position: Lexicon = POSITION
    factor: Lexicon = FACTOR
    age: Lexicon = AGE
    body: Lexicon = BODY
    positive: Lexicon = POSITIVE
    negative: Lexicon = NEGATIVE
    position_texts: Mapping[str, str] = None
    age_texts: Mapping[str, str] = None
    position_default: str = fv.POSITION_STRATEGY_DEFAULT
    age_default: str = fv.AGE_STRATEGY_DEFAULT

    def __post_init__(self):
        if self.position_texts is None:
            object.__setattr__(self, "position_texts", fv.POSITION_STRATEGIES)
        if self.age_texts is None:
            object.__setattr__(self, "age_texts", fv.AGE_STRATEGIES)


def _scores(reviews: DataFrame, lexicon: Lexicon, by: str) -> DataFrame:
    """Per group, all categories with occurrence score, total score and rank."""
    keywords = lexicon.keywords
    cells = F.concat(one("all"), hit_cells("hit", occurrence_hits(F.col("text"), keywords)))
    wide = profile(reviews, [by], cells, {"scores": occurrence_scores("hit", keywords, lexicon)})
    everything = F.aggregate("scores", F.lit(0).cast("long"), lambda acc, s: acc + s["score"])
    return wide.select(by, everything.alias("total"), F.posexplode("scores").alias("pos", "s")).select(
        by, "s.category", "s.score", "total", (F.col("pos") + 1).alias("rn")
    )


def positioning(reviews: DataFrame, lexicon: Lexicon = POSITION, by: str = "brand") -> DataFrame:
    """Occurrences of position keywords over all texts of a brand, their share and rank; all
    positions present. Without any occurrence the shares are 0 and lexicon order ranks."""
    share = F.coalesce(pct(F.col("score"), F.nullif("total", F.lit(0))), F.lit(0.0))
    return _scores(reviews, lexicon, by).select(
        by, F.col("category").alias("position"), "score", share.alias("pct"), "rn"
    )


def top_positions(reviews: DataFrame, lexicon: Lexicon = POSITION, n: int = 3) -> DataFrame:
    return positioning(reviews, lexicon).filter(F.col("rn") <= n)


def target_scores(reviews: DataFrame, lexicon: Lexicon = AGE, by: str = "brand") -> DataFrame:
    """Occurrences of target group keywords and rank; ties and all-zero go to lexicon order."""
    return _scores(reviews, lexicon, by).select(by, F.col("category").alias("group"), "score", "rn")


def purchase_factors(reviews: DataFrame, lexicon: Lexicon = FACTOR, by: str = "brand") -> DataFrame:
    """Reviews mentioning a factor, their share of the brand's reviews, and rank; factors not
    mentioned are absent, and as a review may mention several the shares can pass 100 together."""
    keywords = lexicon.keywords
    factors = category_cells("factor", keywords, lexicon)
    cells = F.concat(one("all"), factors)
    rows = with_hits(reviews.select(by, "text"), keywords)
    wide = profile(
        rows, [by], cells, {"reviews": total("all"), "factors": presences("factor", lexicon)}
    )
    return wide.select(by, "reviews", F.posexplode("factors").alias("pos", "f")).select(
        by, F.col("f.category").alias("factor"), F.col("f.n").alias("reviews"),
        pct(F.col("f.n"), F.col("reviews")).alias("pct"), (F.col("pos") + 1).alias("rn"),
    )


def factor_examples(
    reviews: DataFrame, key: Sequence[str], lexicon: Lexicon = FACTOR, n: int = 3, chars: int = 100
) -> DataFrame:
    """Beginning of the first n reviews mentioning each factor, per brand."""
    rows = reviews.filter(F.col("brand").isNotNull())
    return category_examples(rows, ["brand"], key, lexicon, n, chars).withColumnRenamed(
        "category", "factor"
    )


def factor_matrix(
    reviews: DataFrame,
    brands: Sequence[str],
    lexicon: Lexicon = FACTOR,
    factors: Sequence[str] = tuple(fv.RADAR_FACTORS),
) -> DataFrame:
    """Share of each factor for the chosen brands, 0 where a factor is not mentioned."""
    chosen = reviews.filter(F.col("brand").isin(list(brands)))
    pivoted = (
        purchase_factors(chosen, lexicon).groupBy("brand").pivot("factor", list(factors))
        .agg(F.first("pct"))
    )
    present = chosen.filter(F.col("brand").isNotNull()).select("brand").distinct()
    return present.join(pivoted, "brand", "left").na.fill(0.0, list(factors))


def swot_cells() -> Column:
    return F.concat(one("all"), reason_cells("positive"), reason_cells("negative"))


def swot_aggregates(n: int = 5) -> dict[str, Column]:
    return {
        "scored": total("all"),
        "positive": total("positive"),
        "negative": total("negative"),
        "strengths": reasons("positive", n),
        "weaknesses": reasons("negative", n),
    }


def brand_strengths_weaknesses(scored: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent stored reasons of a brand's positive and negative reviews."""
    wide = profile(scored, ["brand"], swot_cells(), swot_aggregates(n))
    kinds = F.array(
        F.struct(F.lit("strength").alias("kind"), F.col("positive").alias("of"), F.col("strengths").alias("items")),
        F.struct(F.lit("weakness").alias("kind"), F.col("negative").alias("of"), F.col("weaknesses").alias("items")),
    )
    return (
        wide.select("brand", F.inline(kinds))
        .select("brand", "kind", "of", F.posexplode("items").alias("pos", "r"))
        .select(
            "brand", "kind", "r.category", "r.keyword", "r.frequency",
            pct(F.col("r.frequency"), F.col("of")).alias("percentage"),
            (F.col("pos") + 1).alias("rn"),
        )
    )


def brand_ratios(scored: DataFrame) -> DataFrame:
    """Positive and negative share of each brand's reviews."""
    return (
        scored.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(*[
            pct(F.count_if(F.col("sentiment") == s), F.count("*")).alias(f"{s}_pct")
            for s in ("positive", "negative")
        ])
    )


def _product_stats(products: DataFrame) -> DataFrame:
    return (
        products.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(
            F.count("*").alias("products"),
            F.avg("price").alias("avg_price"),
            F.avg("discount_pct").alias("avg_discount"),
        )
    )


def _with_product_stats(by_brand: DataFrame, products: DataFrame) -> DataFrame:
    """Left join of two brand-level aggregates; means are 0 only for brands without products."""
    absent = F.col("products").isNull()
    return by_brand.join(_product_stats(products), "brand", "left").withColumns(
        {
            "avg_price": F.when(absent, 0.0).otherwise(F.col("avg_price")),
            "avg_discount": F.when(absent, 0.0).otherwise(F.col("avg_discount")),
            "products": F.coalesce("products", F.lit(0)),
        }
    )


def brand_basic_stats(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Review and product figures of every brand that has reviews."""
    measured = (
        reviews.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(F.count("*").alias("reviews"), F.countDistinct("product_id").alias("reviewed_products"))
    )
    return _with_product_stats(measured, products).select(
        "brand", "products", "reviews", "reviewed_products", "avg_price", "avg_discount"
    )


def _trend_aggregates() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.avg(F.length(F.coalesce("text", F.lit("")))).alias("avg_length"),
        image_share().alias("image_pct"),
        F.avg("helpful_count").alias("helpful_avg"),
    ]


def review_trends(reviews: DataFrame) -> DataFrame:
    """Per brand: reviews, mean length, image share, mean helpful count."""
    return reviews.filter(F.col("brand").isNotNull()).groupBy("brand").agg(*_trend_aggregates())


def page_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per brand and page."""
    known = reviews.filter(F.col("brand").isNotNull() & F.col("page_number").isNotNull())
    return known.groupBy("brand", "page_number").agg(F.count("*").alias("reviews"))


def _selected(df: DataFrame, brands: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the chosen brands, a list or a frame. The size of a frame is not known here, so the
    join is left to the optimizer: it broadcasts a top-k and shuffles anything large."""
    if brands is None:
        return df
    if isinstance(brands, DataFrame):
        return df.join(brands.select("brand"), "brand", "left_semi")
    return df.filter(F.col("brand").isin(list(brands)))


def trend_cells() -> Column:
    """What review_trends and the number of reviewed products are made of."""
    return F.concat(
        one("length", F.length(F.coalesce("text", F.lit("")))),
        flag_cells("image", F.col("has_image") == "Y"),
        measure_cells("helpful", F.col("helpful_count")),
        value_cells("product", F.col("product_id")),
    )


def trend_sums() -> dict[str, Column]:
    return {
        "avg_length": mean("length"),
        "image_pct": pct(total("image"), total("length")),
        "helpful_avg": mean("helpful"),
        "reviewed_products": distinct("product"),
    }


def brand_overview(
    reviews: DataFrame,
    products: DataFrame,
    words: BrandWords = BrandWords(),
    scored: DataFrame | None = None,
    n: int = 5,
    trends: bool = False,
) -> DataFrame:
    """One row per brand with reviews: counts, shares, ranked lists and product figures.

    The texts are read once: positions, ages, body types, factors, (with ``trends``) lengths, images,
    helpful counts and reviewed products, and (unless already scored reviews are given) sentiment
    reasons all come from the same pass.
    """
    counted = unique([*words.position.keywords, *words.age.keywords, *words.body.keywords])
    opinions = [] if scored is not None else [*words.positive.keywords, *words.negative.keywords]
    keywords = unique([*counted, *words.factor.keywords, *opinions])
    present_only = frozenset(keywords) - frozenset(counted)
    rows = computed_once(reviews, _found=occurrence_hits(F.col("text"), keywords, present_only))
    rows = computed_once(rows, _hits=F.array_distinct("_found"))
    if scored is None:
        rows = score_hits(rows, keywords, words.positive, words.negative)
    factors = category_cells("factor", keywords, words.factor)
    counting = [k for k in keywords if hit_weight(k, counted, present_only)]
    cells = [one("review"), hit_cells("hit", F.filter("_found", lambda h: h.isin(counting))), factors]
    aggregates = {
        "reviews": total("review"),
        "positions": occurrence_scores("hit", keywords, words.position, present_only),
        "ages": occurrence_scores("hit", keywords, words.age, present_only),
        "bodies": occurrence_scores("hit", keywords, words.body, present_only),
        "factors": presences("factor", words.factor),
    }
    if trends:
        cells.append(trend_cells())
        aggregates |= trend_sums()
    if scored is None:
        cells.append(swot_cells())
        aggregates |= swot_aggregates(n)
    wide = profile(rows, ["brand"], F.concat(*cells), aggregates)
    if scored is not None:
        swot = profile(scored, ["brand"], swot_cells(), swot_aggregates(n))
        wide = wide.join(swot, "brand", "left")

    spoken = F.aggregate("positions", F.lit(0).cast("long"), lambda acc, s: acc + s["score"])

    def share(part: str) -> Column:
        return F.coalesce(pct(F.col(part), F.nullif("scored", F.lit(0))), F.lit(0.0))

    return _with_product_stats(wide, products).withColumns(
        {
            "position_total": spoken,
            "position": F.get("positions", F.lit(0))["category"],
            "age": F.coalesce(F.get("ages", F.lit(0))["category"], F.lit("Unknown")),
            "body": F.coalesce(F.get("bodies", F.lit(0))["category"], F.lit("Unknown")),
            "top_factor": F.coalesce(F.get("factors", F.lit(0))["category"], F.lit("Unknown")),
            "top_factor_pct": F.coalesce(
                pct(F.get("factors", F.lit(0))["n"], F.col("reviews")), F.lit(0.0)
            ),
            "positive_pct": share("positive"),
            "negative_pct": share("negative"),
        }
    )


def _as_shares(items: str, count: str, whole: str) -> Column:
    """Ranked list as (category, count, pct)."""
    return F.transform(
        items,
        lambda s: F.struct(
            s["category"].alias("category"), s[count].alias(count),
            F.coalesce(pct(s[count], F.nullif(F.col(whole), F.lit(0))), F.lit(0.0)).alias("pct"),
        ),
    )


def _as_reasons(items: str, whole: str) -> Column:
    return F.transform(
        F.coalesce(F.col(items), F.array().cast(
            "array<struct<order:bigint,category:string,keyword:string,frequency:bigint>>")),
        lambda r: F.struct(
            r["category"].alias("category"), r["keyword"].alias("keyword"),
            r["frequency"].alias("frequency"),
            pct(r["frequency"], F.col(whole)).alias("percentage"),
        ),
    )


def _suggestions(words: BrandWords) -> Column:
    """Array of (kind, rn, subject, text, priority) from strengths, weaknesses, position and age."""

    def row(kind: str, rn: Column, subject: Column, text: Column, priority: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), rn.cast("int").alias("rn"), subject.alias("subject"),
            text.alias("text"), priority.cast("string").alias("priority"),
        )

    def chosen(texts: Mapping[str, str], value: Column, default: str) -> Column:
        found = F.create_map(*[F.lit(v) for k, t in texts.items() for v in (k, t)])[value] if texts else F.lit(None)
        return F.coalesce(found, F.lit(default))

    none = F.lit(None)
    fixed = F.array(
        row("positioning", F.lit(1), F.col("position"),
            chosen(words.position_texts, F.col("position"), words.position_default), none),
        row("target", F.lit(1), F.col("age"),
            chosen(words.age_texts, F.col("age"), words.age_default), none),
    )
    fixed = F.filter(fixed, lambda s: s["subject"].isNotNull() & (s["subject"] != "Unknown"))
    improve = F.transform(
        F.slice("weak", 1, 3),
        lambda w, i: row("improvement", i + 1, w["category"], w["keyword"],
                         F.when(w["percentage"] > 20, "High").otherwise("Medium")),
    )
    advantage = F.transform(
        F.slice("strong", 1, 3),
        lambda s, i: row(
            "advantage", i + 1,
            F.replace(F.replace(F.lit(fv.ADVANTAGE_TEMPLATE), F.lit("{category}"), s["category"]),
                      F.lit("{keyword}"), s["keyword"]),
            F.replace(F.lit(fv.ADVANTAGE_USAGE_TEMPLATE), F.lit("{pct}"), percent_format(s["percentage"])),
            none,
        ),
    )
    return F.concat(fixed, improve, advantage)


def brand_report(
    reviews: DataFrame,
    products: DataFrame,
    words: BrandWords = BrandWords(),
    scored: DataFrame | None = None,
    brands: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Full report, one row per brand that has reviews, sections as arrays of structs whose length the
    word lists bound. Reviews per page, which nothing bounds, are rows of ``page_distribution``."""
    reviews, products = _selected(reviews, brands), _selected(products, brands)
    scored = None if scored is None else _selected(scored, brands)
    wide = (
        brand_overview(reviews, products, words, scored, trends=True)
        .withColumn("strong", _as_reasons("strengths", "positive"))
        .withColumn("weak", _as_reasons("weaknesses", "negative"))
        .withColumn("suggestions", _suggestions(words))
    )
    return wide.select(
        "brand", "products", "reviews", "reviewed_products", "avg_price", "avg_discount",
        _as_shares("positions", "score", "position_total").alias("positions"), "position",
        _as_shares("factors", "n", "reviews").alias("factors"),
        F.transform("ages", lambda s: F.struct(s["category"], s["score"])).alias("ages"), "age",
        F.transform("bodies", lambda s: F.struct(s["category"], s["score"])).alias("bodies"), "body",
        F.col("strong").alias("strengths"), F.col("weak").alias("weaknesses"),
        "positive_pct", "negative_pct", "avg_length", "image_pct", "helpful_avg",
        "suggestions",
    )


def marketing_suggestions(report: DataFrame) -> DataFrame:
    """Suggestions of a brand report as rows (brand, kind, rn, subject, text, priority)."""
    return report.select("brand", F.inline("suggestions"))


def top_brands(reviews: DataFrame, n: int) -> DataFrame:
    """The n brands with most reviews."""
    return (
        reviews.filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), "brand")
        .limit(n)
        .select("brand")
    )


def compare_brands(
    brands: int | Sequence[str] | DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    words: BrandWords = BrandWords(),
    scored: DataFrame | None = None,
) -> DataFrame:
    """One row per chosen brand with its headline figures and three ranks.

    Names are filtered on before anything is read; a frame of brands is joined to the brand-level
    rows, and a number takes that many most reviewed brands of them, so that reviews and products are
    read once whatever the choice is.
    """
    named = brands if isinstance(brands, Sequence) else None
    chosen = [None if df is None else _selected(df, named) for df in (reviews, products, scored)]
    overview = brand_overview(chosen[0], chosen[1], words, chosen[2]).select(
        "brand", "reviews", "positive_pct", "position", "top_factor", "top_factor_pct", "avg_price", "age",
    )
    if isinstance(brands, int):
        kept = overview.orderBy(F.desc("reviews"), "brand").limit(brands)
    else:
        kept = _selected(overview, brands)
    return brand_rankings(kept)


def brand_rankings(comparison: DataFrame) -> DataFrame:
    """Ranks by reviews, positive share and mean price over any number of brands; ties go to the brand
    name, missing values last. The comparison is stored, then ranked by range counts."""
    keys = {rank: [Key(column, ascending=False), Key("brand", nulls_last=False)] for rank, column in RANKS.items()}
    return ranked(stored(comparison, "comparison"), keys)


def comparison_table(comparison: DataFrame) -> DataFrame:
    """Comparison with figures rounded to one digit, halves to even."""
    rounded = {c: F.bround(c, 1) for c in ("positive_pct", "top_factor_pct", "avg_price")}
    return comparison.drop(*RANKS).withColumns(rounded)


def benchmark_brands(
    reviews: DataFrame,
    products: DataFrame,
    words: BrandWords = BrandWords(),
    scored: DataFrame | None = None,
    n: int = 5,
) -> DataFrame:
    """The n most reviewed brands: position, positive share, first strength, mean price."""
    strength = F.coalesce(F.get("strengths", F.lit(0))["category"], F.lit("N/A"))
    overview = brand_overview(reviews, products, words, scored)
    return overview.orderBy(F.desc("reviews"), "brand").limit(n).select(
        "brand", "reviews", "position", "positive_pct", strength.alias("top_strength"), "avg_price"
    )


def brand_export(
    reviews: DataFrame,
    products: DataFrame,
    words: BrandWords = BrandWords(),
    scored: DataFrame | None = None,
    n: int = 5,
) -> DataFrame:
    """Export rows of the n most reviewed brands."""
    return benchmark_brands(reviews, products, words, scored, n).select(
        "brand", "reviews", "positive_pct", "position", "avg_price"
    )
