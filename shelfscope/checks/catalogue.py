"""Checks of the catalogue operators: name -> (Spark query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.checks import views as v
from shelfscope.functions import values as fn
from shelfscope.operators import bins, filters, ordering, stats, styles
from shelfscope.operators.collection import dedup_by_link
from shelfscope.operators.ranges import page_at
from shelfscope.plans.reports import CatalogueQuery, catalogue_page
from shelfscope.sources import tables

QUERIES: dict = {}
OFFERS = v.with_sql(v.OFFERS_SQL)
CATALOGUE = v.with_sql(v.CATALOGUE_SQL)
SHOWN = ["product_id", "brand", "name", "price", "discount_pct", "l_orderkey", "l_linenumber"]
SHOWN_SQL = ", ".join(SHOWN)
TERM = "^(old|RED) |#1$"


def check(name: str, sql: str | None = None):
    def register(fn_):
        QUERIES[name] = (fn_, sql)
        return fn_

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@check("src_canonicalize", """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS brand, p_name AS name,
       p_retailprice AS price, p_name AS style_text, CAST(NULL AS DOUBLE) AS discount_pct,
       CAST(NULL AS VARCHAR) AS link
FROM part""")
def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = v.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("상품ID"), F.col("p_brand").alias("브랜드"),
        F.col("p_name").alias("상품명"), F.concat(F.lit(" "), F.col("p_retailprice").cast("string")).alias("가격"),
    )
    out = tables.canonicalize(raw, "products")
    return out.select("product_id", "brand", "name", "price", "style_text", "discount_pct", "link")


@check("src_union_catalogues", CATALOGUE + """
SELECT product_id, brand, name, price, 'red' AS search_term FROM catalogue WHERE name LIKE '%red%'
UNION ALL
SELECT product_id, brand, name, price, NULL FROM catalogue WHERE name LIKE '%blue%'""")
def union_catalogues(spark, sf):
    base = v.catalogue(spark, sf).drop("discount_pct")
    red = base.filter(F.contains("name", F.lit("red"))).withColumn("search_term", F.lit("red"))
    return tables.union_catalogues(red, base.filter(F.contains("name", F.lit("blue"))))


MESSY = """CASE l_linenumber WHEN 1 THEN ' ' || l_quantity || ' ' WHEN 2 THEN l_quantity || 'f'
  WHEN 3 THEN '1,' || l_quantity WHEN 4 THEN l_quantity || '%' WHEN 5 THEN 'NaN' WHEN 6 THEN ''
  ELSE l_quantity || '' END"""


def _messy(spark, sf):
    text = F.col("l_quantity").cast("string")
    n = F.col("l_linenumber")
    messy = (
        F.when(n == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(n == 2, F.concat(text, F.lit("f"))).when(n == 3, F.concat(F.lit("1,"), text))
        .when(n == 4, F.concat(text, F.lit("%"))).when(n == 5, "NaN").when(n == 6, "").otherwise(text)
    )
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", messy.alias("raw"))


@check("cln_coerce_numeric", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN isnan(x) THEN NULL ELSE x END AS value
FROM (SELECT l_orderkey, l_linenumber, TRY_CAST(trim({MESSY}) AS DOUBLE) AS x FROM lineitem)""")
def coerce_numeric(spark, sf):
    return _messy(spark, sf).select(
        "l_orderkey", "l_linenumber", fn.coerce_numeric(F.col("raw")).alias("value"))


@check("cln_parse_money_percent", f"""
SELECT l_orderkey, l_linenumber,
       TRY_CAST(regexp_replace({MESSY}, '[^0-9.]', '', 'g') AS DOUBLE) AS value FROM lineitem""")
def parse_money_percent(spark, sf):
    return _messy(spark, sf).select(
        "l_orderkey", "l_linenumber", fn.parse_money_percent(F.col("raw")).alias("value"))


@check("prj_display_columns", CATALOGUE + """
SELECT brand, name, price, discount_pct, product_id FROM catalogue ORDER BY product_id LIMIT 100""")
def display_columns(spark, sf):
    return filters.display_columns(v.catalogue(spark, sf), ["product_id"])


@check("prj_preview", CATALOGUE + "SELECT * FROM catalogue ORDER BY product_id LIMIT 20")
def preview(spark, sf):
    return filters.preview(v.catalogue(spark, sf), ["product_id"])


@check("prj_brand_name_text", CATALOGUE + "SELECT product_id, brand || ' ' || name AS text FROM catalogue")
def brand_name_text(spark, sf):
    return filters.brand_name_text(v.catalogue(spark, sf)).select("product_id", "text")


@check("prj_brand_options", CATALOGUE + "SELECT DISTINCT brand FROM catalogue")
def brand_options(spark, sf):
    return filters.brand_options(v.catalogue(spark, sf))


@check("flt_search_keyword", CATALOGUE + f"""
SELECT * FROM catalogue WHERE regexp_matches(name, '{TERM}', 'i') OR regexp_matches(brand, '{TERM}', 'i')""")
def search_keyword(spark, sf):
    return filters.search_keyword(v.catalogue(spark, sf), TERM)


@check("flt_search_literal", CATALOGUE + """
SELECT * FROM catalogue WHERE contains(lower(name), 'd r') OR contains(lower(brand), 'd r')""")
def search_literal(spark, sf):
    return filters.search_keyword(v.catalogue(spark, sf), "D R", literal=True)


@check("flt_price_band", OFFERS + f"SELECT {SHOWN_SQL} FROM offers WHERE price > 30000 AND price <= 50000")
def price_band(spark, sf):
    return filters.price_band_filter(v.offers(spark, sf), "3-5만원").select(*SHOWN)


@check("flt_price_range", OFFERS + f"SELECT {SHOWN_SQL} FROM offers WHERE price BETWEEN 40000 AND 45000")
def price_range(spark, sf):
    return filters.price_range_filter(v.offers(spark, sf), 40000, 45000).select(*SHOWN)


@check("flt_min_discount", OFFERS + f"SELECT {SHOWN_SQL} FROM offers WHERE discount_pct >= 8")
def min_discount(spark, sf):
    return filters.min_discount_filter(v.offers(spark, sf), 8).select(*SHOWN)


@check("flt_brand_in", OFFERS + f"SELECT {SHOWN_SQL} FROM offers WHERE brand IN ('Brand#3', 'Brand#12')")
def brand_in(spark, sf):
    return filters.brand_in_filter(v.offers(spark, sf), ["Brand#3", "Brand#12"]).select(*SHOWN)


@check("flt_default_brands", CATALOGUE + """
SELECT brand FROM (SELECT brand, min(product_id) AS k FROM catalogue GROUP BY brand ORDER BY k LIMIT 10)""")
def default_brands(spark, sf):
    return filters.default_brand_selection(v.catalogue(spark, sf), ["product_id"])


@check("flt_discounted_only", OFFERS + f"SELECT {SHOWN_SQL} FROM offers WHERE discount_pct > 0")
def discounted_only(spark, sf):
    return filters.discounted_only(v.offers(spark, sf)).select(*SHOWN)


@check("flt_high_discount_count", OFFERS + "SELECT count(*) AS n FROM offers WHERE discount_pct > 5")
def high_discount(spark, sf):
    return filters.high_discount_count(v.offers(spark, sf), 5)


@check("flt_detail_search", CATALOGUE + """
SELECT * FROM catalogue
WHERE (regexp_matches(name, 'r', 'i') OR regexp_matches(brand, 'r', 'i'))
  AND price >= 905 AND price <= 1500 AND brand IN ('Brand#1', 'Brand#2', 'Brand#7', 'Brand#11')
  AND (contains(name, 'o') OR contains(name, 'small'))
  AND (contains(name, 'red') OR contains(name, 'blue') OR contains(name, 'lue b') OR contains(name, 'cold'))
  AND (contains(name, 'ring') OR contains(name, 'rod') OR contains(name, 'bolt'))""")
def detail_search(spark, sf):
    return filters.detail_search(
        v.catalogue(spark, sf), "r", 905, 1500, ["Brand#1", "Brand#2", "Brand#7", "Brand#11"],
        categories=["o", "small"], colors=["red", "blue", "cold"], patterns=["ring"],
        color_words=v.COLOR_LEX, pattern_words=v.STYLE_LEX,
    )


TERMS = ["red", " HOT ", "", "ring$", "#5$", "red"]


@check("flt_batch_search", CATALOGUE + """
SELECT term AS search_term, c.* FROM catalogue c
JOIN (VALUES ('red'), ('HOT'), ('ring$'), ('#5$')) t(term)
  ON regexp_matches(name, term, 'i') OR regexp_matches(brand, term, 'i')""")
def batch_search(spark, sf):
    return filters.batch_keyword_search(v.catalogue(spark, sf), TERMS)


@check("flt_batch_search_dedup", CATALOGUE + """
SELECT search_term, link, min(product_id) AS product_id
FROM (SELECT term AS search_term, product_id, '/item/' || name AS link FROM catalogue
      JOIN (VALUES ('red'), ('HOT'), ('ring$'), ('#5$')) t(term)
        ON regexp_matches(name, term, 'i') OR regexp_matches(brand, term, 'i'))
GROUP BY search_term, link""")
def batch_search_dedup(spark, sf):
    found = filters.batch_keyword_search(v.catalogue(spark, sf), TERMS)
    linked = found.withColumn("link", F.concat(F.lit("/item/"), F.col("name")))
    return dedup_by_link(linked, ["product_id"], by=["search_term"]).select(
        "search_term", "link", "product_id")


for _by, _order in (
    ("price_asc", "price ASC NULLS LAST"), ("price_desc", "price DESC NULLS LAST"),
    ("discount_desc", "discount_pct DESC NULLS LAST"), ("brand", "brand ASC NULLS LAST"),
):
    @check(f"srt_{_by}_page", OFFERS + f"""
    SELECT {SHOWN_SQL} FROM offers ORDER BY {_order}, {v.OFFER_KEY_SQL} LIMIT 20 OFFSET 60""")
    def sorted_page(spark, sf, by=_by):
        rows = v.offers(spark, sf)
        return ordering.page(rows, 4, ordering.sort_order(by, v.OFFER_KEY)).select(*SHOWN)


@check("srt_sort_products", OFFERS + f"SELECT {SHOWN_SQL} FROM offers ORDER BY brand, {v.OFFER_KEY_SQL}")
def sort_products(spark, sf):
    return ordering.sort_products(v.offers(spark, sf), "brand", v.OFFER_KEY).select(*SHOWN)


@check("srt_global_numbers", OFFERS + f"""
SELECT {SHOWN_SQL}, row_no FROM (
  SELECT *, row_number() OVER (ORDER BY price, {v.OFFER_KEY_SQL}) AS row_no FROM offers)""")
def global_numbers(spark, sf):
    rows = ordering.numbered(v.offers(spark, sf), ordering.sort_order("price_asc", v.OFFER_KEY))
    return rows.select(*SHOWN, "row_no")


@check("srt_deep_page", OFFERS + f"""
SELECT {SHOWN_SQL} FROM offers ORDER BY price DESC, {v.OFFER_KEY_SQL} LIMIT 20 OFFSET 4980""")
def deep_page(spark, sf):
    """Page 250; ranges of at most 500 rows are sorted."""
    return page_at(v.offers(spark, sf), 250, ordering.sort_keys("price_desc", v.OFFER_KEY), enough=500).select(*SHOWN)


@check("srt_page_count", OFFERS + "SELECT CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM offers")
def page_count(spark, sf):
    return ordering.page_count(v.offers(spark, sf))


@check("plan_search_page", OFFERS + f"""
SELECT {SHOWN_SQL} FROM offers
WHERE (regexp_matches(name, 'ring', 'i') OR regexp_matches(brand, 'ring', 'i'))
  AND price > 50000 AND price <= 100000 AND discount_pct >= 2 AND brand = 'Brand#7'
ORDER BY discount_pct DESC, {v.OFFER_KEY_SQL} LIMIT 20 OFFSET 20""")
def search_page(spark, sf):
    query = CatalogueQuery(v.OFFER_KEY, term="ring", band=2, min_discount=2, brands="Brand#7",
                           sort="할인율 높은순", page=2)
    return catalogue_page(v.offers(spark, sf), query).select(*SHOWN)


@check("top_discount", OFFERS + f"""
SELECT {SHOWN_SQL} FROM offers ORDER BY discount_pct DESC NULLS LAST, {v.OFFER_KEY_SQL} LIMIT 10""")
def top_discount(spark, sf):
    return ordering.top_discount(v.offers(spark, sf), v.OFFER_KEY).select(*SHOWN)


VALUE = """scored_offers AS (
  SELECT *, (price - lo) / (hi - lo) AS price_norm, discount_pct / 100 AS discount_norm,
         (discount_pct / 100) / ((price - lo) / (hi - lo) + 0.1) AS value_score
  FROM offers, (SELECT min(price) AS lo, max(price) AS hi FROM offers))"""


@check("mth_value_score", v.with_sql(v.OFFERS_SQL, VALUE) + f"""
SELECT {SHOWN_SQL}, round(price_norm, 4) AS price_norm, round(discount_norm, 4) AS discount_norm,
       round(value_score, 4) AS value_score FROM scored_offers""")
def value_score(spark, sf):
    scored = styles.value_score(v.offers(spark, sf)).select(
        *SHOWN, "price_norm", "discount_norm", "value_score")
    return rounded(scored, "price_norm", "discount_norm", "value_score")


@check("top_value", v.with_sql(v.OFFERS_SQL, VALUE) + f"""
SELECT {SHOWN_SQL}, round(value_score, 4) AS value_score FROM scored_offers
ORDER BY scored_offers.value_score DESC NULLS LAST, {v.OFFER_KEY_SQL} LIMIT 10""")
def top_value(spark, sf):
    return rounded(styles.top_value(v.offers(spark, sf), v.OFFER_KEY).select(*SHOWN, "value_score"),
                   "value_score")


@check("top_priority_products", CATALOGUE + """
SELECT * FROM catalogue WHERE brand IN (
  SELECT brand FROM catalogue GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 6)
ORDER BY product_id LIMIT 5""")
def priority_products(spark, sf):
    return ordering.priority_products(v.catalogue(spark, sf), ["product_id"], brands=6)


@check("top_cap_catalogue", OFFERS + """
SELECT link, min(l_orderkey) AS l_orderkey FROM (SELECT '/p/' || product_id AS link, * FROM offers)
GROUP BY link ORDER BY link LIMIT 500""")
def cap_catalogue(spark, sf):
    linked = v.offers(spark, sf).withColumn("link", F.concat(F.lit("/p/"), F.col("product_id")))
    unique = dedup_by_link(linked, v.OFFER_KEY)
    return ordering.cap_catalogue(unique, 500, ["link"]).select("link", "l_orderkey")


@check("agg_catalogue_kpis", OFFERS + """
SELECT count(*) AS products, count(DISTINCT brand) AS brands, round(avg(price), 4) AS avg_price,
       round(avg(discount_pct), 4) AS avg_discount FROM offers""")
def catalogue_kpis(spark, sf):
    return rounded(stats.catalogue_kpis(v.offers(spark, sf)), "avg_price", "avg_discount")


@check("agg_search_summary", OFFERS + """
SELECT count(*) AS products, round(avg(price), 4) AS avg_price,
       round(avg(discount_pct), 4) AS avg_discount FROM offers WHERE price BETWEEN 30000 AND 60000""")
def search_summary(spark, sf):
    found = filters.price_range_filter(v.offers(spark, sf), 30000, 60000)
    return rounded(stats.search_summary(found), "avg_price", "avg_discount")


@check("agg_price_stats", OFFERS + """
SELECT round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price,
       CAST(trunc(min(price)) AS BIGINT) AS slider_min, CAST(trunc(max(price)) AS BIGINT) AS slider_max
FROM offers""")
def price_stats(spark, sf):
    return rounded(stats.price_stats(v.offers(spark, sf)), "avg_price")


@check("agg_price_positioning", OFFERS + """
SELECT round(avg(price), 4) AS avg_price, round(median(price), 4) AS median_price,
       round(avg(discount_pct), 4) AS avg_discount,
       CASE WHEN avg(price) > 50000 THEN 'premium' ELSE 'mid_low' END AS tier,
       CASE WHEN avg(discount_pct) > 5 THEN 'active' ELSE 'selective' END AS policy FROM offers""")
def price_positioning(spark, sf):
    out = stats.price_positioning(v.offers(spark, sf), premium=50000, active=5)
    return rounded(out, "avg_price", "median_price", "avg_discount")


DESCRIBED = ["price", "discount_pct", "l_quantity"]


@check("agg_describe_numeric", OFFERS + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 3) AS mean,
       round(stddev_samp({c}), 3) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 3) AS p25,
       round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75,
       max({c}) AS "max" FROM offers""" for c in DESCRIBED))
def describe_numeric(spark, sf):
    out = stats.describe_numeric(v.offers(spark, sf), DESCRIBED)
    return rounded(out, "mean", "std", "p25", "p50", "p75", digits=3)


def _by_brand(value: str, name: str, n: int) -> str:
    return OFFERS + f"""SELECT brand, {value} AS {name} FROM offers GROUP BY brand
    ORDER BY {name} DESC NULLS LAST, brand LIMIT {n}"""


@check("agg_brand_counts", _by_brand("count(*)", "products", 15))
def brand_counts(spark, sf):
    return stats.brand_counts(v.offers(spark, sf), 15)


@check("agg_brand_avg_price", _by_brand("round(avg(price), 4)", "avg_price", 15))
def brand_avg_price(spark, sf):
    return rounded(stats.brand_avg_price(v.offers(spark, sf), 15), "avg_price")


@check("agg_brand_avg_discount", _by_brand("round(avg(discount_pct), 4)", "avg_discount", 10))
def brand_avg_discount(spark, sf):
    return rounded(stats.brand_avg_discount(v.offers(spark, sf), 10), "avg_discount")


@check("brd_top_brand_list", CATALOGUE + """
SELECT string_agg(brand, ', ' ORDER BY n DESC, brand) AS text FROM (
  SELECT brand, count(*) AS n FROM catalogue GROUP BY brand ORDER BY n DESC, brand LIMIT 5)""")
def top_brand_list(spark, sf):
    return stats.top_brand_list(v.catalogue(spark, sf))


def _bands(column: str, edges, labels) -> str:
    rows = ", ".join(
        f"({i}, '{label}', {edges[i]}, {'1e308' if edges[i + 1] == float('inf') else edges[i + 1]})"
        for i, label in enumerate(labels)
    )
    return OFFERS + f"""
    SELECT b.band_ord, b.band, count(o.{column}) AS n
    FROM (VALUES {rows}) b(band_ord, band, lo, hi)
    LEFT JOIN offers o ON o.{column} > b.lo AND o.{column} <= b.hi GROUP BY b.band_ord, b.band"""


@check("bin_price_bands", _bands("price", fv.PRICE_EDGES, fv.PRICE_LABELS))
def price_bands(spark, sf):
    return bins.price_bands(v.offers(spark, sf))


@check("bin_discount_bands", _bands("discount_pct", fv.DISCOUNT_EDGES, fv.DISCOUNT_LABELS))
def discount_bands(spark, sf):
    return bins.discount_bands(v.offers(spark, sf))


def histogram_sql(source: str, column: str, n: int, where: str = "true") -> str:
    return source + f""",
    r AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source.split('AS')[0].split()[-1]} WHERE {where}),
    m AS (SELECT min(v) AS least, (max(v) - min(v)) / {n} AS width FROM r)
    SELECT bin, round(least + width * (bin - 1), 4) AS lo, round(least + width * bin, 4) AS hi,
           count(*) AS n
    FROM (SELECT CAST(least({n}, floor((v - least) / width) + 1) AS INTEGER) AS bin, least, width FROM r, m)
    GROUP BY bin, least, width"""


@check("bin_price_histogram", histogram_sql(OFFERS, "price", 30))
def price_histogram(spark, sf):
    return rounded(bins.histogram(v.offers(spark, sf), "price", 30), "lo", "hi")


@check("bin_discount_histogram", histogram_sql(OFFERS, "discount_pct", 20, "discount_pct > 0"))
def discount_histogram(spark, sf):
    found = filters.discounted_only(v.offers(spark, sf))
    return rounded(bins.histogram(found, "discount_pct", 20), "lo", "hi")


def _styles(words: dict, keep_zero: bool) -> str:
    join = "LEFT JOIN" if keep_zero else "JOIN"
    return v.with_sql(v.CATALOGUE_SQL, v.lex_sql("lex", words)) + f"""
    SELECT category, count(c.name) AS n FROM lex {join} catalogue c ON contains(c.name, keyword)
    GROUP BY category"""


@check("sty_style_counts", _styles(v.STYLE, keep_zero=False))
def style_counts(spark, sf):
    return styles.style_counts(v.catalogue(spark, sf), v.STYLE_LEX)


@check("sty_style_counts_full", _styles(v.STYLE, keep_zero=True))
def style_counts_full(spark, sf):
    return styles.style_counts_full(v.catalogue(spark, sf), v.STYLE_LEX)


@check("sty_color_counts", _styles(v.COLOR, keep_zero=True))
def color_counts(spark, sf):
    return styles.color_counts(v.catalogue(spark, sf), v.COLOR_LEX)


@check("mth_formats", OFFERS + """
SELECT l_orderkey, l_linenumber, l_quantity,
       CAST(CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS VARCHAR) AS shown,
       CAST(least(5, floor(discount_pct * 9 / 20) + 1) AS INTEGER) AS severity,
       discount_pct - 50 AS delta FROM offers""")
def formats(spark, sf):
    rows = v.offers(spark, sf)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        fn.percent_format(F.col("l_quantity") / 4).alias("shown"),
        fn.severity_level(F.col("discount_pct") * 9).alias("severity"),
        fn.delta_vs_half(F.col("discount_pct")).alias("delta"),
    )
