"""Checks of the review operators: name -> (Spark query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.checks import views as v
from shelfscope.checks.catalogue import histogram_sql, rounded
from shelfscope.functions import values as fn
from shelfscope.operators import bins, insights, ordering, sentiment, stats
from shelfscope.operators import trends as trend_ops
from shelfscope.operators.large_lexicon import score_large_lexicon
from shelfscope.sources import sinks

QUERIES: dict = {}
REVIEWS = v.with_sql(v.REVIEWS_SQL)
SCORED = v.with_sql(v.REVIEWS_SQL, v.SCORED_SQL)
THREADS = v.with_sql(v.THREADS_SQL)
SENTIMENTS = ("positive", "negative", "neutral")


def check(name, sql=None):
    def register(fn_):
        QUERIES[name] = (fn_, sql)
        return fn_

    return register


def scored(spark, sf):
    return sentiment.score_sentiment(v.reviews(spark, sf), v.POSITIVE_LEX, v.NEGATIVE_LEX)


@check("sen_score_sentiment", SCORED + """
SELECT review_id, product_id, brand, sentiment, positive_score, negative_score,
       positive_reasons, negative_reasons FROM scored""")
def score_sentiment(spark, sf):
    return scored(spark, sf).select(
        "review_id", "product_id", "brand", "sentiment", "positive_score", "negative_score",
        sinks.pack_reasons(F.col("positive_reasons")).alias("positive_reasons"),
        sinks.pack_reasons(F.col("negative_reasons")).alias("negative_reasons"),
    )


# A lexicon out of the given tables: the words of the benchmark, good ones of even length, bad ones of odd.
LARGE_SQL = r"""lexicon AS (
  SELECT word, left(word, 2) AS category, length(word) AS cat_ord, unicode(substr(word, 2, 1)) AS kw_ord,
         CASE WHEN length(word) % 2 = 0 THEN 'positive' ELSE 'negative' END AS side
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]{6,}')) AS word FROM benchmark)),
hits AS (
  SELECT review_id, side, count(*) AS n, string_agg(category || ':' || word, ', ' ORDER BY cat_ord, kw_ord, category, word) AS told
  FROM reviews JOIN lexicon ON contains(text, word) GROUP BY ALL)
"""


@check("sen_large_lexicon", v.with_sql(v.REVIEWS_SQL, LARGE_SQL) + """
SELECT r.review_id, CAST(coalesce(p.n, 0) AS INTEGER) AS positive_score, CAST(coalesce(n.n, 0) AS INTEGER) AS negative_score,
       CASE WHEN coalesce(p.n, 0) > coalesce(n.n, 0) THEN 'positive' WHEN coalesce(n.n, 0) > coalesce(p.n, 0) THEN 'negative' ELSE 'neutral' END AS sentiment,
       coalesce(p.told, '') AS positive_reasons, coalesce(n.told, '') AS negative_reasons
FROM reviews r LEFT JOIN hits p ON r.review_id = p.review_id AND p.side = 'positive'
               LEFT JOIN hits n ON r.review_id = n.review_id AND n.side = 'negative'""")
def large_lexicon(spark, sf):
    """All words of the benchmark as a lexicon table, all reasons kept."""
    words = v.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))).alias("keyword")).distinct()
    lexicon = words.select(
        F.when(F.length("keyword") % 2 == 0, "positive").otherwise("negative").alias("lexicon"), F.left("keyword", F.lit(2)).alias("category"),
        F.length("keyword").alias("cat_ord"), F.ascii(F.substring("keyword", 2, 1)).alias("kw_ord"), "keyword",
    )
    found = score_large_lexicon(v.reviews(spark, sf).select("review_id", "text"), lexicon, ["review_id"], max_reasons=None)
    return found.select(
        "review_id", "sentiment", "positive_score", "negative_score",
        sinks.pack_reasons(F.col("positive_reasons")).alias("positive_reasons"),
        sinks.pack_reasons(F.col("negative_reasons")).alias("negative_reasons"),
    )


@check("src_reasons_round_trip", SCORED + """
SELECT review_id, len(string_split(positive_reasons, ', ')) FILTER (positive_reasons <> '') AS n,
       positive_reasons AS packed FROM scored GROUP BY ALL""".replace(
    "len(string_split(positive_reasons, ', ')) FILTER (positive_reasons <> '')",
    "CAST(CASE WHEN positive_reasons = '' THEN 0 ELSE len(string_split(positive_reasons, ', ')) END AS INTEGER)",
).replace(" GROUP BY ALL", ""))
def reasons_round_trip(spark, sf):
    packed = scored(spark, sf).select("review_id", sinks.pack_reasons(F.col("positive_reasons")).alias("p"))
    back = packed.select("review_id", sentiment.unpack_reasons(F.col("p")).alias("r"))
    return back.select("review_id", F.size("r").alias("n"), sinks.pack_reasons(F.col("r")).alias("packed"))


@check("sen_sentiment_counts", SCORED + """
SELECT sentiment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 4) AS pct
FROM scored GROUP BY sentiment""")
def sentiment_counts(spark, sf):
    return rounded(sentiment.sentiment_counts(scored(spark, sf)), "pct")


MATRIX = """SELECT brand, count(*) FILTER (sentiment = 'positive') AS positive,
       count(*) FILTER (sentiment = 'negative') AS negative,
       count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total
FROM scored GROUP BY brand"""


@check("sen_brand_matrix", SCORED + MATRIX + " ORDER BY total DESC, brand LIMIT 10")
def brand_matrix(spark, sf):
    return sentiment.brand_sentiment_matrix(scored(spark, sf))


@check("sen_brand_positive_ratio", SCORED + f"""
SELECT brand, total AS reviews, round(positive * 100.0 / total, 4) AS positive_pct FROM ({MATRIX})
ORDER BY positive * 100.0 / total DESC, brand LIMIT 15""")
def brand_positive_ratio(spark, sf):
    return rounded(sentiment.brand_positive_ratio(scored(spark, sf)), "positive_pct")


@check("sen_product_sentiment", SCORED + """
SELECT product_id, count(*) AS total,
       round(count(*) FILTER (sentiment = 'positive') * 100.0 / count(*), 4) AS positive_pct,
       round(count(*) FILTER (sentiment = 'negative') * 100.0 / count(*), 4) AS negative_pct,
       round(count(*) FILTER (sentiment = 'neutral') * 100.0 / count(*), 4) AS neutral_pct,
       round(avg(positive_score), 4) AS avg_pos, round(avg(negative_score), 4) AS avg_neg
FROM scored GROUP BY product_id""")
def product_sentiment(spark, sf):
    return rounded(sentiment.product_sentiment(scored(spark, sf)), "positive_pct", "negative_pct",
                   "neutral_pct", "avg_pos", "avg_neg")


@check("bin_score_density", SCORED + """
SELECT positive_score, negative_score, sentiment, count(*) AS n FROM scored GROUP BY ALL""")
def score_density(spark, sf):
    return sentiment.score_density(scored(spark, sf))


@check("mth_delta_vs_half", SCORED + """
SELECT round(count(*) FILTER (sentiment = 'positive') * 100.0 / count(*) - 50, 4) AS delta FROM scored""")
def delta_vs_half(spark, sf):
    counted = scored(spark, sf).agg(
        sentiment.pct(F.count_if(F.col("sentiment") == "positive"), F.count("*")).alias("p"))
    return counted.select(F.round(fn.delta_vs_half(F.col("p")), 4).alias("delta"))


@check("top_samples_per_sentiment", SCORED + """
SELECT review_id, sentiment, rn, text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY sentiment ORDER BY review_id) AS INTEGER) AS rn FROM scored)
WHERE rn <= 3""")
def samples(spark, sf):
    return ordering.samples_per_sentiment(scored(spark, sf), v.KEY).select(
        "review_id", "sentiment", "rn", "text")


@check("agg_brand_review_counts", REVIEWS + """
SELECT brand, count(*) AS reviews FROM reviews GROUP BY brand ORDER BY reviews DESC, brand LIMIT 10""")
def brand_review_counts(spark, sf):
    return stats.brand_review_counts(v.reviews(spark, sf))


DIRECTORY = """SELECT product_id, arg_min(brand, review_id) AS brand, count(*) AS reviews
FROM reviews GROUP BY product_id"""


@check("agg_top_reviewed_products", REVIEWS + DIRECTORY + " ORDER BY reviews DESC, product_id LIMIT 10")
def top_reviewed(spark, sf):
    return stats.top_reviewed_products(v.reviews(spark, sf), v.KEY)


@check("agg_product_directory", REVIEWS + DIRECTORY)
def directory(spark, sf):
    return stats.product_directory(v.reviews(spark, sf), v.KEY)


@check("agg_review_length", REVIEWS + "SELECT round(avg(length(text)), 4) AS avg_chars FROM reviews")
def review_length(spark, sf):
    return rounded(stats.review_length(v.reviews(spark, sf)), "avg_chars")


@check("cln_text_or_nan", REVIEWS + """
SELECT review_id, length(coalesce(CASE WHEN page_number > 2 THEN text END, 'nan')) AS n FROM reviews""")
def text_or_nan(spark, sf):
    text = F.when(F.col("page_number") > 2, F.col("text"))
    return v.reviews(spark, sf).select(
        "review_id", F.length(fn.text_or_nan(text, compat_nan=True)).cast("long").alias("n"))


@check("bin_length_histogram", REVIEWS.rstrip() + """,
lengths AS (SELECT length(text) AS chars FROM reviews)""" + histogram_sql("lengths AS", "chars", 30)[len("lengths AS"):])
def length_histogram(spark, sf):
    lengths = v.reviews(spark, sf).select(F.length("text").alias("chars"))
    return rounded(bins.histogram(lengths, "chars", 30), "lo", "hi")


@check("agg_avg_review_pages", THREADS + """
SELECT round(avg(p), 4) AS value FROM (SELECT max(page_number) AS p FROM threads GROUP BY product_id)""")
def avg_review_pages(spark, sf):
    return rounded(stats.avg_review_pages(v.threads(spark, sf)), "value")


@check("agg_review_density", v.with_sql(v.THREADS_SQL, v.CATALOGUE_SQL) + """
SELECT round((SELECT count(*) FROM threads) / (SELECT count(*) FROM catalogue), 4) AS value""")
def review_density(spark, sf):
    unpaged = v.threads(spark, sf).withColumn("page_number", F.lit(None).cast("int"))
    return rounded(stats.avg_review_pages(unpaged, v.catalogue(spark, sf)), "value")


@check("agg_page_counts", THREADS + "SELECT page_number, count(*) AS reviews FROM threads GROUP BY page_number")
def page_counts(spark, sf):
    return stats.page_counts(v.threads(spark, sf))


@check("agg_crawl_brand_stats", REVIEWS + """
SELECT brand, count(DISTINCT product_id) AS products, count(text) AS reviews FROM reviews
GROUP BY brand ORDER BY reviews DESC, brand LIMIT 10""")
def crawl_brand_stats(spark, sf):
    return stats.crawl_brand_stats(v.reviews(spark, sf))


IMAGE = "round(count(*) FILTER (has_image = 'Y') * 100.0 / count(*), 4) AS image_pct"


@check("agg_image_ratio", REVIEWS + f"SELECT {IMAGE} FROM reviews")
def image_ratio(spark, sf):
    return rounded(stats.image_ratio(v.reviews(spark, sf)), "image_pct")


@check("agg_image_ratio_by_brand", REVIEWS + f"SELECT brand, {IMAGE} FROM reviews GROUP BY brand")
def image_ratio_by_brand(spark, sf):
    return rounded(stats.image_ratio(v.reviews(spark, sf), "brand"), "image_pct")


@check("agg_top_image_brands", REVIEWS + f"""
SELECT brand, {IMAGE} FROM reviews GROUP BY brand ORDER BY image_pct DESC, brand LIMIT 5""")
def top_image_brands(spark, sf):
    return rounded(stats.top_image_brands(v.reviews(spark, sf)), "image_pct")


@check("agg_helpful_avg", REVIEWS + "SELECT round(avg(helpful_count), 4) AS value FROM reviews")
def helpful_avg(spark, sf):
    return rounded(stats.helpful_avg(v.reviews(spark, sf)), "value")


@check("agg_distinct_reviewed", REVIEWS + """
SELECT count(DISTINCT product_id) AS products, count(DISTINCT brand) AS brands FROM reviews""")
def distinct_reviewed(spark, sf):
    return stats.distinct_reviewed_products(v.reviews(spark, sf))


@check("tok_extract_keywords", r"""
SELECT doc_id AS review_id, len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: length(w) >= 2)) AS n,
       array_to_string(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: length(w) >= 2), ' ') AS words FROM documents""")
def extract_keywords(spark, sf):
    words = fn.extract_keywords(F.col("text"), v.THEME_PATTERN)
    return v.reviews(spark, sf).select("review_id", words.alias("w")).select(
        "review_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


def _words(where: str, keys: str = "") -> str:
    stop = ", ".join(f"'{w}'" for w in v.STOP)
    return rf"""SELECT {keys} keyword, count(*) AS n
FROM (SELECT {keys} unnest(regexp_extract_all(text, '\p{{L}}+')) AS keyword FROM scored WHERE {where})
WHERE length(keyword) >= 2 AND keyword NOT IN ({stop}) GROUP BY ALL"""


THEMES = {"stop_words": v.STOP, "pattern": v.THEME_PATTERN}


@check("tok_common_themes", SCORED + _words("true") + " ORDER BY n DESC, keyword LIMIT 20")
def common_themes(spark, sf):
    return insights.common_themes(v.reviews(spark, sf), **THEMES)


@check("tok_negative_themes", SCORED + _words("sentiment = 'negative'") + " ORDER BY n DESC, keyword LIMIT 20")
def negative_themes(spark, sf):
    return insights.common_themes(scored(spark, sf), "negative", **THEMES)


@check("tok_product_themes", SCORED + f"""
SELECT product_id, sentiment, keyword, n, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY product_id, sentiment ORDER BY n DESC, keyword) AS INTEGER) AS rn
  FROM ({_words("sentiment <> 'neutral'", "product_id, sentiment,")})) WHERE rn <= 10""")
def product_themes(spark, sf):
    return insights.product_themes(scored(spark, sf), **THEMES)


def reasons_sql(polarity: str, n: int, by: str = "", extra: str = "") -> str:
    side = polarity[:3]
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"t.{by} = c.{by}" if by else "true"
    return f""",
stored AS (SELECT s.*, h.category, h.keyword FROM {side}_hits h JOIN scored s ON s.review_id = h.review_id
           WHERE k <= 3 AND sentiment = '{polarity}'),
counted AS (SELECT {keys} category, keyword, count(*) AS frequency FROM stored GROUP BY ALL),
totals AS (SELECT {keys} count(*) AS total FROM scored WHERE sentiment = '{polarity}' {group}),
ranked AS (SELECT c.*, frequency * 100.0 / total AS pct,
  CAST(row_number() OVER ({part.replace(by, 'c.' + by) if by else ''} ORDER BY frequency DESC, category, keyword) AS INTEGER) AS rn
  FROM counted c JOIN totals t ON {on})
SELECT {keys} category, keyword, frequency, round(pct, 4) AS percentage, rn {extra} FROM ranked WHERE rn <= {n}"""


def message_sql(templates: dict, default: str, pct: str | None) -> str:
    def filled(text: str) -> str:
        out = f"replace('{text}', '{{category}}', category)"
        shown = f"CAST(CAST(round_even({pct}, 0) AS BIGINT) AS VARCHAR)"
        return f"replace({out}, '{{pct}}', {shown})" if pct else out

    whens = " ".join(
        f"WHEN category = '{c}' AND keyword = '{k}' THEN {filled(t)}" for (c, k), t in templates.items())
    return f"CASE {whens} ELSE {filled(default)} END"


MESSAGE = message_sql(v.MESSAGES, v.MESSAGE_DEFAULT, "pct")
SUGGESTION = message_sql(v.SUGGESTIONS, v.SUGGESTION_DEFAULT, None)


@check("ins_top_reasons_positive", SCORED + reasons_sql("positive", 10))
def top_reasons_positive(spark, sf):
    return rounded(insights.top_reasons(scored(spark, sf), "positive", 10), "percentage")


@check("ins_top_reasons_negative", SCORED + reasons_sql("negative", 10))
def top_reasons_negative(spark, sf):
    return rounded(insights.top_reasons(scored(spark, sf), "negative", 10), "percentage")


def strengths(spark, sf, n=5, by=None):
    return insights.top_strengths(
        scored(spark, sf), n, by, templates=v.MESSAGES, default=v.MESSAGE_DEFAULT)


@check("ins_top_strengths", SCORED + reasons_sql("positive", 5, extra=f", {MESSAGE} AS message"))
def top_strengths(spark, sf):
    return rounded(strengths(spark, sf), "percentage")


@check("ins_top_weaknesses", SCORED + reasons_sql("negative", 5, extra=f", {SUGGESTION} AS suggestion"))
def top_weaknesses(spark, sf):
    found = insights.top_weaknesses(
        scored(spark, sf), templates=v.SUGGESTIONS, default=v.SUGGESTION_DEFAULT)
    return rounded(found, "percentage")


@check("ins_marketing_message", SCORED + reasons_sql("positive", 127, extra=f", {MESSAGE} AS message"))
def marketing_message(spark, sf):
    return rounded(strengths(spark, sf, 127), "percentage")


@check("ins_product_strengths", SCORED + reasons_sql("positive", 5, "product_id", f", {MESSAGE} AS message"))
def product_strengths(spark, sf):
    return rounded(strengths(spark, sf, by="product_id"), "percentage")


@check("ins_product_weaknesses", SCORED + reasons_sql("negative", 5, "product_id", f", {SUGGESTION} AS suggestion"))
def product_weaknesses(spark, sf):
    found = insights.top_weaknesses(
        scored(spark, sf), by="product_id", templates=v.SUGGESTIONS, default=v.SUGGESTION_DEFAULT)
    return rounded(found, "percentage")


@check("snk_insight_rows", "SELECT 'strength' AS type, category, keyword, frequency, percentage, message FROM ("
       + SCORED + reasons_sql("positive", 5, extra=f", {MESSAGE} AS message") + ")")
def insight_rows(spark, sf):
    return sinks.insight_rows(rounded(strengths(spark, sf), "percentage"), "strength")


def topics_sql(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    where = "t.{0} = m.{0}".format(by) if by else "true"
    part = f"PARTITION BY m.{by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f""",
{v.lex_sql("lex", v.IMPROVEMENT)},
mentioned AS (SELECT {keys} category, cat_ord, count(DISTINCT review_id) AS n
  FROM scored, lex WHERE sentiment = 'negative' AND contains(text, keyword) GROUP BY ALL),
totals AS (SELECT {keys} count(*) AS total FROM scored WHERE sentiment = 'negative' {group})
SELECT {'m.' + by + ', ' if by else ''} category, n AS count, round(n * 100.0 / total, 4) AS percentage,
  CAST(row_number() OVER ({part} ORDER BY n DESC, cat_ord) AS INTEGER) AS rn
FROM mentioned m JOIN totals t ON {where}"""


@check("ins_improvement_topics", SCORED + topics_sql())
def improvement_topics(spark, sf):
    return rounded(insights.improvement_topics(scored(spark, sf), v.IMPROVEMENT_LEX), "percentage")


@check("ins_product_topics", SCORED + topics_sql("product_id"))
def product_topics(spark, sf):
    found = insights.improvement_topics(scored(spark, sf), v.IMPROVEMENT_LEX, by="product_id")
    return rounded(found, "percentage")


@check("snk_improvement_rows", "SELECT category, count, percentage FROM (" + SCORED + topics_sql() + ")")
def improvement_rows(spark, sf):
    return rounded(sinks.improvement_rows(
        insights.improvement_topics(scored(spark, sf), v.IMPROVEMENT_LEX)), "percentage")


def examples_sql(source: str, words: dict, keys: str, name: str) -> str:
    return f""",
{v.lex_sql("lex", words)},
mentioned AS (SELECT DISTINCT {keys} review_id, category, text FROM {source}, lex WHERE contains(text, keyword))
SELECT {keys} category AS {name}, rn, substr(text, 1, 100) AS text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {keys} category ORDER BY review_id) AS INTEGER) AS rn FROM mentioned)
WHERE rn <= 3"""


@check("ins_topic_examples", SCORED + examples_sql(
    "(SELECT * FROM scored WHERE sentiment = 'negative')", v.IMPROVEMENT, "", "category"))
def topic_examples(spark, sf):
    return insights.topic_examples(scored(spark, sf), v.KEY, v.IMPROVEMENT_LEX)


@check("ins_product_topic_examples", SCORED + examples_sql(
    "(SELECT * FROM scored WHERE sentiment = 'negative')", v.IMPROVEMENT, "product_id,", "category"))
def product_topic_examples(spark, sf):
    return insights.topic_examples(scored(spark, sf), v.KEY, v.IMPROVEMENT_LEX, by="product_id")


def needs_sql(keys: str = "") -> str:
    words = ", ".join(f"('{w}')" for w in v.NEEDS)
    return f""",
sentences AS (SELECT {keys} review_id, unnest(string_split(text, '.')) AS sentence,
                     generate_subscripts(string_split(text, '.'), 1) AS pos FROM reviews),
found AS (SELECT s.*, keyword FROM sentences s JOIN (VALUES {words}) w(keyword) ON contains(sentence, keyword))
SELECT {keys} keyword, rn, sentence FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {keys} keyword ORDER BY review_id, pos) AS INTEGER) AS rn FROM found)
WHERE rn <= 3"""


@check("ins_customer_needs", REVIEWS.rstrip() + needs_sql())
def customer_needs(spark, sf):
    return insights.customer_needs(v.reviews(spark, sf), v.KEY, v.NEEDS)


@check("ins_product_needs", REVIEWS.rstrip() + needs_sql("product_id,"))
def product_needs(spark, sf):
    return insights.customer_needs(v.reviews(spark, sf), v.KEY, v.NEEDS, by="product_id")


THREAD_SCORED = v.with_sql(
    v.THREADS_SQL, "reviews AS (SELECT row_number() OVER () AS review_id, * FROM threads)", v.SCORED_SQL)
CELLS = ", ".join(f"count(*) FILTER (s.sentiment = '{s}') AS {s}" for s in SENTIMENTS)


def scored_threads(spark, sf):
    return sentiment.score_sentiment(v.threads(spark, sf), v.POSITIVE_LEX, v.NEGATIVE_LEX)


@check("jon_page_sentiment_fanout", THREAD_SCORED + f"""
SELECT t.page_number, {CELLS} FROM threads t JOIN scored s ON t.product_id = s.product_id GROUP BY t.page_number""")
def page_sentiment_fanout(spark, sf):
    out = trend_ops.page_sentiment_fanout(v.threads(spark, sf), scored_threads(spark, sf))
    return out.select("page_number", *[F.col(s).cast("long").alias(s) for s in SENTIMENTS])


@check("jon_page_sentiment", THREAD_SCORED + f"SELECT page_number, {CELLS} FROM scored s GROUP BY page_number")
def page_sentiment(spark, sf):
    return trend_ops.page_sentiment(scored_threads(spark, sf))


@check("jon_image_positive_ratio", SCORED + """
SELECT round(count(*) FILTER (sentiment = 'positive') * 100.0 / count(*), 4) AS pct FROM scored
WHERE product_id IN (SELECT product_id FROM reviews WHERE has_image = 'Y')""")
def image_positive_ratio(spark, sf):
    return rounded(trend_ops.image_product_positive_ratio(scored(spark, sf)), "pct")
