"""Checks of page, date, de-duplication and streaming operators: name -> (Spark query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.checks import views as v
from shelfscope.functions import values as fn
from shelfscope.operators import ordering
from shelfscope.operators.collection import dedup_by_link, recent_reviews
from shelfscope.session import rocksdb_state, shared_folder
from shelfscope.sources import pages as pg
from shelfscope.streaming.first_seen import ingest_first_cards, snapshot
from shelfscope.streaming.ingest import ingest_cards_stream

QUERIES: dict = {}
ANY_ANCHOR = pg.CardRules(card_class=None)
HOST = "https://shop.example"
LINKS = r"""WITH links AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a,
         generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages),
parts AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS link,
                 trim(regexp_extract(a, '>([^<]*)<', 1)) AS text FROM links)
"""


def check(name, sql=None):
    def register(fn_):
        QUERIES[name] = (fn_, sql)
        return fn_

    return register


def pages(spark, sf):
    return v.table(spark, sf, "pages")


@check("htm_page_links", LINKS + "SELECT page_id, pos, link, text FROM parts")
def page_links(spark, sf):
    return pg.page_links(pages(spark, sf))


HREF_CARD = pg.CardRules(card_class=None, attributes={"product_id": "href", "price": "data-price"}, name_attribute="href", name_suffix="/")


@check("htm_product_cards", LINKS + """
SELECT p.page_id, url, pos, link AS product_id, '' AS price, trim(replace(link, '/', '')) AS name, '' AS image_url, link
FROM parts p JOIN pages USING (page_id)""")
def product_cards(spark, sf):
    """Anchors as cards: number and name from their address (the given anchors have no other attribute)."""
    cards = pg.extract_product_cards(pages(spark, sf), HREF_CARD)
    return cards.select("page_id", "url", "pos", "product_id", "price", "name", "image_url", "link")


LIST_CARD = pg.DisplayRules(card="nav li", link="a", brand="a", name="li a[href]", price="ul + a",
                            discount="li + li b", complete=False)


@check("htm_display_cards", r"""WITH items AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS a,
         generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS link,
       trim(regexp_extract(a, '">([^<]*)<', 1)) AS brand, '' AS price, '' AS discount_pct FROM items""")
def display_cards(spark, sf):
    cards = pg.extract_display_cards(pages(spark, sf).drop("url"), LIST_CARD)
    return cards.select("page_id", "pos", "link", "brand", "price", "discount_pct")


PAGE_CARD = pg.DisplayRules(card="body", link="li a", brand="article h1", name="li + li a", price="nav + div.ad",
                            discount="article + footer", complete=False)


def _unescaped(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@check("htm_page_cards", f"""
SELECT page_id, CAST(0 AS INTEGER) AS pos, regexp_extract(html, '<li><a href="([^"]*)"', 1) AS link,
       trim({_unescaped("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)")}) AS brand,
       trim({_unescaped("regexp_extract(html, '</li><li><a href=[^>]*>([^<]*)<', 1)")}) AS name,
       trim({_unescaped("regexp_extract(html, '<div class=.ad.>([^<]*)<', 1)")}) AS price,
       trim({_unescaped("regexp_extract(html, '</article><footer>([^<]*)<', 1)")}) AS discount_pct
FROM pages""")
def page_cards(spark, sf):
    """Each page as one card, its fields by descendant and sibling steps."""
    cards = pg.extract_display_cards(pages(spark, sf), PAGE_CARD)
    return cards.select("page_id", "pos", "link", "brand", "name", "price", "discount_pct")


@check("htm_review_blocks", r"""WITH blocks AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<div class="ad">[^<]*</div>')) AS b,
         generate_subscripts(regexp_extract_all(html, '<div class="ad">[^<]*</div>'), 1) - 1 AS pos FROM pages)
SELECT page_id, url, CAST(pos AS INTEGER) AS pos, substr(trim(regexp_extract(b, '>([^<]*)<', 1)), 1, 500) AS text,
       '' AS rating, '' AS author, '' AS date, '' AS option, '0' AS helpful_count, 'N' AS has_image FROM blocks""")
def review_blocks(spark, sf):
    return pg.extract_review_blocks(pages(spark, sf), blocks=["div.ad"])


# Pieces of a page (a tag and the text up to the next one), as in sources.elements; a paragraph ends where the
# running depth of paragraphs is back at its own, or with the article.
PIECES = r"""WITH marked AS (
  SELECT page_id, url, string_split(regexp_replace(html,
    '(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>|<[!?][^>]*>)',
    chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM pages),
pieces AS (
  SELECT page_id, url, i, lower(regexp_extract(part, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
         regexp_replace(regexp_replace(split_part(part, chr(2), -1), '^\s+', ''), '\s+$', '') AS text
  FROM (SELECT page_id, url, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM marked)),
articles AS (
  SELECT o.page_id, o.url, o.i AS a, min(c.i) AS b FROM pieces o JOIN pieces c ON c.page_id = o.page_id AND c.i > o.i
  WHERE o.tag = 'article' AND c.tag = '/article' GROUP BY ALL),
paragraphs AS (
  SELECT r.page_id, a, b, min(i) AS p FROM articles r JOIN pieces USING (page_id) WHERE i > a AND i < b AND tag = 'p' GROUP BY ALL),
depths AS (
  SELECT page_id, a, b, p, i, sum(CASE tag WHEN 'p' THEN 1 WHEN '/p' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, a ORDER BY i) AS depth
  FROM paragraphs JOIN pieces USING (page_id) WHERE i >= p AND i < b),
ends AS (SELECT page_id, a, p, coalesce(min(i) FILTER (depth = 0), b) AS e FROM depths GROUP BY page_id, a, b, p),
texts AS (
  SELECT r.page_id, r.url, r.a,
         string_agg(text, ' ' ORDER BY i) FILTER (text <> '') AS whole, string_agg(text, '' ORDER BY i) FILTER (text <> '' AND i >= p AND i < e) AS content, p
  FROM articles r JOIN pieces USING (page_id) LEFT JOIN ends USING (page_id, a) WHERE i >= r.a AND i < r.b GROUP BY r.page_id, r.url, r.a, p)
"""
RATINGS = ", ".join(f"nullif(regexp_extract(whole, '{fv.RATING_PATTERN}', {k}), '')" for k in (1, 2, 3, 4))


@check("htm_article_blocks", PIECES + f"""
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS INTEGER) AS pos,
       {_unescaped("CASE WHEN p IS NULL THEN left(coalesce(whole, ''), 500) ELSE coalesce(content, '') END")} AS text,
       '' AS author, '' AS date, '' AS option, coalesce({RATINGS}, '') AS rating FROM texts""")
def article_blocks(spark, sf):
    """Basic review layout over the articles of the pages: text of the first paragraph."""
    return pg.extract_review_blocks(pages(spark, sf), enhanced=False, blocks=["article"])


@check("htm_valid_reviews", """
SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) > 120""")
def valid_reviews(spark, sf):
    rows = v.table(spark, sf, "conversations")
    return pg.valid_reviews(rows, 120).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


LABELS = """CASE event_id % 6 WHEN 0 THEN CAST(event_id % 9 AS VARCHAR) || '점' WHEN 1 THEN '별' || CAST(event_id % 9 AS VARCHAR)
  WHEN 2 THEN '★' || CAST(event_id % 9 AS VARCHAR) WHEN 3 THEN '평점 ' || CAST(event_id % 9 AS VARCHAR)
  WHEN 4 THEN 'no number' END"""


@check("htm_review_fields", f"""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '3' WHEN event_id % 6 < 4 THEN CAST(event_id % 9 AS VARCHAR) ELSE '' END AS rating,
       CASE WHEN label IS NULL THEN '0' WHEN event_id % 6 < 4 THEN CAST(event_id % 9 AS VARCHAR) END AS helpful,
       CASE WHEN event_id % 3 > 0 THEN 'Y' ELSE 'N' END AS image
FROM (SELECT event_id, {LABELS} AS label FROM events)""")
def review_fields(spark, sf):
    rows = v.table(spark, sf, "events").select("event_id", F.expr(
        LABELS.replace("VARCHAR", "STRING")).alias("label"))
    stars = F.when(F.col("event_id") % 10 == 0, 3).otherwise(0)
    return rows.select(
        "event_id",
        fn.parse_rating(F.coalesce("label", F.lit("")), stars).alias("rating"),
        fn.helpful_count(F.col("label")).alias("helpful"),
        fn.has_image((F.col("event_id") % 3).cast("int")).alias("image"),
    )


DATES = """CASE event_id % 8 WHEN 0 THEN {n} || '시간 전' WHEN 1 THEN {n} || '일 전' WHEN 2 THEN {n} || '주일 전'
  WHEN 3 THEN {n} || '개월 전' WHEN 4 THEN {dot} WHEN 5 THEN {slash} WHEN 6 THEN {short} ELSE 'yesterday' END"""
DUCK_DATES = DATES.format(
    n="CAST(event_id % 9 + 1 AS VARCHAR)", dot="strftime(ts, '%Y.%m.%d')",
    slash="strftime(ts, '%Y/%m/%d') || ' 10:30'", short="strftime(ts, '%y.%m.%d')")
SPARK_DATES = DATES.format(
    n="CAST(event_id % 9 + 1 AS STRING)", dot="date_format(ts, 'yyyy.MM.dd')",
    slash="concat(date_format(ts, 'yyyy/MM/dd'), ' 10:30')", short="date_format(ts, 'yy.MM.dd')")


def _ago(weeks: int) -> str:
    as_of = f"TIMESTAMP '{v.AS_OF}'"
    return f"""CASE event_id % 8 WHEN 0 THEN {as_of} - to_hours(event_id % 9 + 1)
  WHEN 1 THEN {as_of} - to_days(CAST(event_id % 9 + 1 AS INTEGER))
  WHEN 2 THEN {as_of} - to_days(CAST((event_id % 9 + 1) * {weeks} AS INTEGER))
  WHEN 3 THEN {as_of} - to_days(CAST((event_id % 9 + 1) * 30 AS INTEGER))
  WHEN 7 THEN {{failed}} ELSE date_trunc('day', ts) END"""


def _parsed(spark, sf, compat):
    raw = v.table(spark, sf, "events").select("event_id", F.expr(SPARK_DATES).alias("raw"))
    as_of = F.lit(v.AS_OF).cast("timestamp")
    parsed = fn.parse_review_date(F.col("raw"), as_of, compat)
    return raw.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("date"))


@check("dat_parse_review_date", f"""
SELECT event_id, strftime({_ago(7).format(failed="NULL")}, '%Y-%m-%d %H:%M:%S') AS date FROM events""")
def parse_review_date(spark, sf):
    return _parsed(spark, sf, compat=False)


@check("dat_parse_review_date_compat", f"""
SELECT event_id, strftime({_ago(1).format(failed=f"TIMESTAMP '{v.AS_OF}'")}, '%Y-%m-%d %H:%M:%S') AS date FROM events""")
def parse_review_date_compat(spark, sf):
    return _parsed(spark, sf, compat=True)


DATED = v.with_sql(v.DATED_SQL)
CUTOFF = f"TIMESTAMP '{v.AS_OF}' - INTERVAL 10 DAY"


@check("dat_recent_reviews", DATED + f"SELECT pos, product_id, page_number FROM dated WHERE date >= {CUTOFF}")
def recent(spark, sf):
    as_of = F.lit(v.AS_OF).cast("timestamp")
    return recent_reviews(v.dated(spark, sf), as_of, 10).select("pos", "product_id", "page_number")


@check("dat_recent_reviews_strict", DATED + f"""
SELECT pos, product_id, page_number FROM (
  SELECT *, max(CASE WHEN date < {CUTOFF} THEN 1 ELSE 0 END)
    OVER (PARTITION BY product_id ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING) AS stopped FROM dated)
WHERE stopped = 0""")
def recent_strict(spark, sf):
    as_of = F.lit(v.AS_OF).cast("timestamp")
    return recent_reviews(v.dated(spark, sf), as_of, 10, strict=True).select(
        "pos", "product_id", "page_number")


@check("top_cap_per_product", DATED + """
SELECT pos, product_id, page_number FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY page_number, pos) AS rn FROM dated) WHERE rn <= 25""")
def cap_per_product(spark, sf):
    return ordering.cap_per_product(v.dated(spark, sf), n=25).select("pos", "product_id", "page_number")


@check("ded_dedup_by_link", LINKS + f"""
SELECT page_id, pos, '{HOST}' || link AS link FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM parts WHERE link <> '') WHERE rn = 1""")
def dedup(spark, sf):
    links = pg.page_links(pages(spark, sf))
    return dedup_by_link(links, ["page_id", "pos"], HOST).select("page_id", "pos", "link")


@check("str_ingest_cards_stream", LINKS + "SELECT DISTINCT link FROM parts WHERE link <> ''")
def ingest_stream(spark, sf):
    """The page table as a stream of files, run to the end; unique links as written by the sink."""
    run = shared_folder(spark, "ingest")
    query = ingest_cards_stream(
        spark, sf, f"{run}/out", f"{run}/state", rules=ANY_ANCHOR, file_name="pages.parquet")
    query.awaitTermination()
    return spark.read.schema("link string").parquet(f"{run}/out")


@check("str_first_cards", LINKS + f"""
SELECT page_id, pos, '{HOST}' || link AS link, link AS product_id, trim(replace(link, '/', '')) AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM parts WHERE link <> '') WHERE rn = 1""")
def first_cards(spark, sf):
    """The page table as a stream; the snapshot after its last step has the first card of every link."""
    run = shared_folder(spark, "first-cards")
    with rocksdb_state(spark):
        ingest_first_cards(
            spark, sf, f"{run}/out", f"{run}/state", rules=HREF_CARD, host=HOST, bytes_per_step=1 << 30, file_name="pages.parquet").awaitTermination()
    return snapshot(spark, f"{run}/out").select("page_id", "pos", "link", "product_id", "name")
