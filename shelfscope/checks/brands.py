"""Checks of the brand operators: name -> (Spark query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.checks import views as v
from shelfscope.checks.catalogue import rounded
from shelfscope.checks.reviews import examples_sql, scored
from shelfscope.operators import brands, sentiment

QUERIES: dict = {}
REVIEWS = v.with_sql(v.REVIEWS_SQL)
SCORED = v.with_sql(v.REVIEWS_SQL, v.SCORED_SQL)
BRAND_SCORED = v.with_sql(v.BRAND_REVIEWS_SQL, v.SCORED_SQL, v.CATALOGUE_SQL)
WORDS = brands.BrandWords(
    v.POSITION_LEX, v.FACTOR_LEX, v.AGE_LEX, v.BODY_LEX, v.POSITIVE_LEX, v.NEGATIVE_LEX,
    v.POSITION_TEXTS, v.AGE_TEXTS, "brand identity", "age group",
)


def check(name, sql=None):
    def register(fn_):
        QUERIES[name] = (fn_, sql)
        return fn_

    return register


def _occurrences(name: str, words: dict) -> str:
    """Occurrences of every category per brand, with rank."""
    return f"""{v.lex_sql(name + "_lex", words)},
{name}_counts AS (
  SELECT brand, category, cat_ord,
         CAST(sum((length(text) - length(replace(text, keyword, ''))) // length(keyword)) AS BIGINT) AS score
  FROM reviews, {name}_lex GROUP BY brand, category, cat_ord),
{name} AS (
  SELECT *, coalesce(score * 100.0 / nullif(sum(score) OVER (PARTITION BY brand), 0), 0) AS pct,
         CAST(row_number() OVER (PARTITION BY brand ORDER BY score DESC, cat_ord) AS INTEGER) AS rn
  FROM {name}_counts)"""


def _factors() -> str:
    return f"""{v.lex_sql("factor_lex", v.FACTOR)},
factor_counts AS (SELECT brand, category, cat_ord, count(DISTINCT review_id) AS n FROM reviews, factor_lex
  WHERE contains(text, keyword) GROUP BY brand, category, cat_ord),
brand_totals AS (SELECT brand, count(*) AS total FROM reviews GROUP BY brand),
factors AS (SELECT f.*, n * 100.0 / total AS pct,
  CAST(row_number() OVER (PARTITION BY f.brand ORDER BY n DESC, cat_ord) AS INTEGER) AS rn
  FROM factor_counts f JOIN brand_totals t ON f.brand = t.brand)"""


def _swot() -> str:
    sides = []
    for kind, polarity in (("strength", "positive"), ("weakness", "negative")):
        sides.append(f"""SELECT '{kind}' AS kind, '{polarity}' AS polarity, s.brand, h.category, h.keyword, count(*) AS frequency
  FROM {polarity[:3]}_hits h JOIN scored s ON s.review_id = h.review_id
  WHERE k <= 3 AND sentiment = '{polarity}' GROUP BY ALL""")
    return f"""swot_counts AS ({' UNION ALL '.join(sides)}),
swot_totals AS (SELECT brand, sentiment, count(*) AS total FROM scored GROUP BY ALL),
swot AS (SELECT c.*, frequency * 100.0 / total AS pct,
  CAST(row_number() OVER (PARTITION BY c.brand, kind ORDER BY frequency DESC, category, keyword) AS INTEGER) AS rn
  FROM swot_counts c JOIN swot_totals t ON c.brand = t.brand AND c.polarity = t.sentiment),
ratios AS (SELECT brand, count(*) AS reviews,
  count(*) FILTER (sentiment = 'positive') * 100.0 / count(*) AS positive_pct,
  count(*) FILTER (sentiment = 'negative') * 100.0 / count(*) AS negative_pct FROM scored GROUP BY brand)"""


PRODUCTS = """product_stats AS (SELECT brand, count(*) AS products, avg(price) AS avg_price,
  avg(discount_pct) AS avg_discount FROM catalogue GROUP BY brand)"""


@check("brd_positioning", v.with_sql(v.REVIEWS_SQL, _occurrences("positions", v.POSITION)) + """
SELECT brand, category AS position, score, round(pct, 4) AS pct, rn FROM positions""")
def positioning(spark, sf):
    return rounded(brands.positioning(v.reviews(spark, sf), v.POSITION_LEX), "pct")


@check("brd_top_positions", v.with_sql(v.REVIEWS_SQL, _occurrences("positions", v.POSITION)) + """
SELECT brand, category AS position, score, round(pct, 4) AS pct, rn FROM positions WHERE rn <= 3""")
def top_positions(spark, sf):
    return rounded(brands.top_positions(v.reviews(spark, sf), v.POSITION_LEX), "pct")


@check("brd_purchase_factors", v.with_sql(v.REVIEWS_SQL, _factors()) + """
SELECT brand, category AS factor, n AS reviews, round(pct, 4) AS pct, rn FROM factors""")
def purchase_factors(spark, sf):
    return rounded(brands.purchase_factors(v.reviews(spark, sf), v.FACTOR_LEX), "pct")


@check("brd_factor_examples", REVIEWS.rstrip() + examples_sql("reviews", v.FACTOR, "brand,", "factor"))
def factor_examples(spark, sf):
    return brands.factor_examples(v.reviews(spark, sf), v.KEY, v.FACTOR_LEX)


CHOSEN = ["src1", "src7", "src12"]


@check("brd_factor_matrix", v.with_sql(v.REVIEWS_SQL, _factors()) + f"""
SELECT b.brand, {', '.join(f"round(coalesce(max(pct) FILTER (category = '{f}'), 0), 4) AS {f}" for f in v.RADAR)}
FROM (SELECT DISTINCT brand FROM reviews) b LEFT JOIN factors f ON b.brand = f.brand
WHERE b.brand IN ('src1', 'src7', 'src12') GROUP BY b.brand""")
def factor_matrix(spark, sf):
    out = brands.factor_matrix(v.reviews(spark, sf), CHOSEN, v.FACTOR_LEX, v.RADAR)
    return rounded(out, *v.RADAR)


@check("brd_age_scores", v.with_sql(v.REVIEWS_SQL, _occurrences("ages", v.AGE)) + """
SELECT brand, category AS "group", score, rn FROM ages""")
def age_scores(spark, sf):
    return brands.target_scores(v.reviews(spark, sf), v.AGE_LEX)


@check("brd_body_scores", v.with_sql(v.REVIEWS_SQL, _occurrences("bodies", v.BODY)) + """
SELECT brand, category AS "group", score, rn FROM bodies""")
def body_scores(spark, sf):
    return brands.target_scores(v.reviews(spark, sf), v.BODY_LEX)


@check("brd_strengths_weaknesses", SCORED.rstrip() + ",\n" + _swot() + """
SELECT brand, kind, category, keyword, frequency, round(pct, 4) AS percentage, rn FROM swot WHERE rn <= 5""")
def strengths_weaknesses(spark, sf):
    return rounded(brands.brand_strengths_weaknesses(scored(spark, sf)), "percentage")


@check("brd_ratios", SCORED.rstrip() + ",\n" + _swot() + """
SELECT brand, round(positive_pct, 4) AS positive_pct, round(negative_pct, 4) AS negative_pct FROM ratios""")
def ratios(spark, sf):
    return rounded(brands.brand_ratios(scored(spark, sf)), "positive_pct", "negative_pct")


@check("brd_basic_stats", v.with_sql(v.BRAND_REVIEWS_SQL, v.CATALOGUE_SQL,
                                     PRODUCTS) + """
SELECT r.brand, coalesce(products, 0) AS products, r.reviews, r.reviewed_products,
       round(coalesce(avg_price, 0), 4) AS avg_price, round(coalesce(avg_discount, 0), 4) AS avg_discount
FROM (SELECT brand, count(*) AS reviews, count(DISTINCT product_id) AS reviewed_products FROM reviews GROUP BY brand) r
LEFT JOIN product_stats p ON r.brand = p.brand""")
def basic_stats(spark, sf):
    stats = brands.brand_basic_stats(v.brand_reviews(spark, sf), v.catalogue(spark, sf))
    return rounded(stats, "avg_price", "avg_discount")


@check("brd_review_trends", REVIEWS + """
SELECT brand, count(*) AS total, round(avg(length(text)), 4) AS avg_length,
       round(count(*) FILTER (has_image = 'Y') * 100.0 / count(*), 4) AS image_pct,
       round(avg(helpful_count), 4) AS helpful_avg FROM reviews GROUP BY brand""")
def review_trends(spark, sf):
    return rounded(brands.review_trends(v.reviews(spark, sf)), "avg_length", "image_pct", "helpful_avg")


@check("brd_page_distribution", REVIEWS + """
SELECT brand, page_number, count(*) AS reviews FROM reviews GROUP BY brand, page_number""")
def page_distribution(spark, sf):
    return brands.page_distribution(v.reviews(spark, sf))


OVERVIEW = v.with_sql(
    v.BRAND_REVIEWS_SQL, v.SCORED_SQL, v.CATALOGUE_SQL, _occurrences("positions", v.POSITION),
    _occurrences("ages", v.AGE), _factors(), _swot(), PRODUCTS,
    """overview AS (
  SELECT r.brand, r.reviews, r.positive_pct, p.category AS position, coalesce(f.category, 'Unknown') AS top_factor,
         coalesce(f.pct, 0) AS top_factor_pct, coalesce(s.avg_price, 0) AS avg_price, a.category AS age,
         coalesce(w.category, 'N/A') AS top_strength
  FROM ratios r JOIN positions p ON r.brand = p.brand AND p.rn = 1
  JOIN ages a ON r.brand = a.brand AND a.rn = 1
  LEFT JOIN factors f ON r.brand = f.brand AND f.rn = 1
  LEFT JOIN swot w ON r.brand = w.brand AND w.kind = 'strength' AND w.rn = 1
  LEFT JOIN product_stats s ON r.brand = s.brand)""",
    "top AS (SELECT * FROM overview ORDER BY reviews DESC, brand LIMIT 5)",
)


def _parts(spark, sf):
    return v.brand_reviews(spark, sf), v.catalogue(spark, sf)


@check("brd_compare_brands", OVERVIEW + """
SELECT brand, reviews, round(positive_pct, 4) AS positive_pct, position, top_factor,
       round(top_factor_pct, 4) AS top_factor_pct, round(avg_price, 4) AS avg_price, age,
       CAST(row_number() OVER (ORDER BY reviews DESC, brand) AS INTEGER) AS rank_reviews,
       CAST(row_number() OVER (ORDER BY t.positive_pct DESC, brand) AS INTEGER) AS rank_positive,
       CAST(row_number() OVER (ORDER BY t.avg_price DESC, brand) AS INTEGER) AS rank_price
FROM (SELECT * FROM overview ORDER BY reviews DESC, brand LIMIT 10) t""")
def compare_brands(spark, sf):
    reviews, products = _parts(spark, sf)
    out = brands.compare_brands(10, reviews, products, WORDS)
    return rounded(out, "positive_pct", "top_factor_pct", "avg_price")


@check("brd_comparison_table", OVERVIEW + """
SELECT brand, reviews, round_even(positive_pct, 1) AS positive_pct, position, top_factor,
       round_even(top_factor_pct, 1) AS top_factor_pct, round_even(avg_price, 1) AS avg_price, age
FROM overview WHERE brand IN ('Brand#3', 'Brand#8', 'Brand#20')""")
def comparison_table(spark, sf):
    reviews, products = _parts(spark, sf)
    scored_ = sentiment.score_sentiment(reviews, v.POSITIVE_LEX, v.NEGATIVE_LEX)
    chosen = ["Brand#3", "Brand#8", "Brand#20"]
    return brands.comparison_table(brands.compare_brands(chosen, reviews, products, WORDS, scored_))


@check("brd_benchmark", OVERVIEW + """
SELECT brand, reviews, position, round(positive_pct, 4) AS positive_pct, top_strength,
       round(avg_price, 4) AS avg_price FROM top""")
def benchmark(spark, sf):
    reviews, products = _parts(spark, sf)
    return rounded(brands.benchmark_brands(reviews, products, WORDS), "positive_pct", "avg_price")


@check("snk_brand_export", OVERVIEW + """
SELECT brand, reviews, round(positive_pct, 4) AS positive_pct, position, round(avg_price, 4) AS avg_price FROM top""")
def brand_export(spark, sf):
    reviews, products = _parts(spark, sf)
    return rounded(brands.brand_export(reviews, products, WORDS), "positive_pct", "avg_price")


def _texts(texts: dict, column: str, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in texts.items())
    return f"CASE {column} {whens} ELSE '{default}' END"


_ADVANTAGE = fv.ADVANTAGE_TEMPLATE.replace("{category}", "' || category || '").replace("{keyword}", "' || keyword || '")
_USAGE = fv.ADVANTAGE_USAGE_TEMPLATE.replace("{pct}", "' || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '")


@check("brd_marketing_suggestions", OVERVIEW + f"""
SELECT brand, 'positioning' AS kind, CAST(1 AS INTEGER) AS rn, position AS subject,
       {_texts(v.POSITION_TEXTS, 'position', 'brand identity')} AS text, CAST(NULL AS VARCHAR) AS priority FROM overview
UNION ALL SELECT brand, 'target', 1, age, {_texts(v.AGE_TEXTS, 'age', 'age group')}, NULL FROM overview
UNION ALL SELECT brand, 'improvement', rn, category, keyword, CASE WHEN pct > 20 THEN 'High' ELSE 'Medium' END
  FROM swot WHERE kind = 'weakness' AND rn <= 3
UNION ALL SELECT brand, 'advantage', rn, '{_ADVANTAGE}', '{_USAGE}', NULL FROM swot WHERE kind = 'strength' AND rn <= 3""")
def marketing_suggestions(spark, sf):
    reviews, products = _parts(spark, sf)
    return brands.marketing_suggestions(brands.brand_report(reviews, products, WORDS))


@check("brd_brand_report", OVERVIEW.rstrip() + ",\n" + _occurrences("bodies", v.BODY) + """,
lists AS (
  SELECT brand, string_agg(category || '=' || CAST(score AS VARCHAR), ' ' ORDER BY rn) FILTER (kind = 'age') AS ages,
         string_agg(category || '=' || CAST(score AS VARCHAR), ' ' ORDER BY rn) FILTER (kind = 'body') AS bodies,
         string_agg(category || '=' || CAST(score AS VARCHAR), ' ' ORDER BY rn) FILTER (kind = 'factor') AS factors
  FROM (SELECT 'age' AS kind, brand, category, score, rn FROM ages UNION ALL SELECT 'body', brand, category, score, rn FROM bodies
        UNION ALL SELECT 'factor', brand, category, n, rn FROM factors) GROUP BY brand),
flat AS (SELECT brand, string_agg(category || '=' || CAST(score AS VARCHAR), ' ' ORDER BY rn) AS positions
         FROM positions GROUP BY brand),
weak AS (SELECT brand, string_agg(category || ':' || keyword || '=' || CAST(frequency AS VARCHAR), ' ' ORDER BY rn) AS weaknesses
         FROM swot WHERE kind = 'weakness' AND rn <= 5 GROUP BY brand),
strong AS (SELECT brand, string_agg(category || ':' || keyword || '=' || CAST(frequency AS VARCHAR), ' ' ORDER BY rn) AS strengths
         FROM swot WHERE kind = 'strength' AND rn <= 5 GROUP BY brand),
lengths AS (SELECT brand, avg(length(text)) AS avg_length, count(DISTINCT product_id) AS reviewed_products,
            avg(helpful_count) AS helpful_avg, count(*) FILTER (has_image = 'Y') * 100.0 / count(*) AS image_pct
            FROM reviews GROUP BY brand)
SELECT o.brand, o.reviews, o.position, o.age, round(o.positive_pct, 4) AS positive_pct, f.positions,
       coalesce(w.weaknesses, '') AS weaknesses, coalesce(g.strengths, '') AS strengths,
       round(l.avg_length, 4) AS avg_length, round(l.helpful_avg, 4) AS helpful_avg, round(l.image_pct, 4) AS image_pct,
       l.reviewed_products, o.top_factor, round(o.avg_price, 4) AS avg_price, ages, bodies, coalesce(factors, '') AS factors,
       round(r.negative_pct, 4) AS negative_pct, coalesce(ps.products, 0) AS products, round(coalesce(ps.avg_discount, 0), 4) AS avg_discount
FROM overview o JOIN lists USING (brand) JOIN ratios r USING (brand) LEFT JOIN product_stats ps USING (brand) JOIN flat f USING (brand) LEFT JOIN weak w USING (brand) LEFT JOIN strong g USING (brand)
JOIN lengths l USING (brand)""")
def brand_report(spark, sf):
    reviews, products = _parts(spark, sf)
    report = brands.brand_report(reviews, products, WORDS)

    def joined(column, render):
        return F.array_join(F.transform(column, render), " ").alias(column)

    def reasons(column):
        return joined(column, lambda w: F.concat(w["category"], F.lit(":"), w["keyword"], F.lit("="),
                                                 w["frequency"].cast("string")))

    shown = report.select(
        "brand", "reviews", "position", "age", "positive_pct",
        joined("positions", lambda p: F.concat_ws("=", p["category"], p["score"].cast("string"))),
        reasons("weaknesses"), reasons("strengths"),
        "avg_length", "helpful_avg", "image_pct", "reviewed_products",
        F.coalesce(F.get("factors", F.lit(0))["category"], F.lit("Unknown")).alias("top_factor"), "avg_price",
        *[joined(c, lambda p: F.concat_ws("=", p["category"], p["score"].cast("string"))) for c in ("ages", "bodies")],
        joined("factors", lambda p: F.concat_ws("=", p["category"], p["n"].cast("string"))), "negative_pct", "products", "avg_discount",
    )
    return rounded(shown, "positive_pct", "avg_length", "helpful_avg", "image_pct", "avg_price", "negative_pct", "avg_discount")
