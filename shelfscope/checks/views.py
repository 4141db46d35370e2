"""The given tables seen as products, reviews and pages, for Spark and as SQL.

The word lists here are parameters of the checks: fragments that occur in the given texts, some of
them prefixes of others and some overlapping themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.lexicon import Lexicon
from shelfscope.sources.tables import dealt

POSITIVE = {
    "design": ["lyea", "ouat", "nlye", "erie", "ntho", "étio", "étion"],
    "quality": ["hren", "chen", "rnte", "natt", "nans", "reshe", "gtion"],
    "fit": ["hreh", "utre", "nlyt", "hndi", "rres", "hesti", "rement"],
    "price": ["ever", "este", "ouai", "enzu", "erge", "nhati", "ngtion"],
    "comfort": ["hstn", "nlys", "revi", "rach", "eert", "ntiin", "hanble"],
    "joy": ["avec", "ónos", "nesh", "quei", "chen", "ouat", "thonth"],
    "colour": ["uxti", "ache", "tone", "iónq", "inve", "erest", "ciónqu"],
    "size": ["eedt", "uach", "eate", "ungs", "natn", "honan", "quemen"],
    "fabric": ["itch", "rern", "oime", "date", "nenti", "theas", "onment"],
}
NEGATIVE = {
    "size": ["blel", "blebl", "htht", "keit", "enkeit", "éier", "hndh"],
    "quality": ["hlic", "hver", "hsch", "hsta", "èeux", "ouing", "thblee"],
    "fabric": ["chei", "nwha", "erzu", "nors", "hnth", "blere", "bleor"],
    "colour": ["ètre", "hshi", "redt", "leeu", "rano", "hanin", "ththo"],
    "delivery": ["ungt", "intz", "ewho", "eits", "Thou", "erese", "nblet"],
    "price": ["rren", "nanh", "iónj", "enqu", "ónta", "thret", "hathe"],
    "design": ["eera", "taux", "eado", "rinh", "iónó", "nenst", "rlich"],
    "wear": ["neah", "itke", "hlyl", "queé", "hndw", "erate", "oninge"],
    "trouble": ["itau", "hings", "thhes", "heaea", "hesin", "onhee", "sment"],
}
IMPROVEMENT = {
    "chart": ["haner", "erent", "nshat", "iónar"],
    "fabric": ["rhati", "aiier", "erheo", "onwhe"],
    "colour": ["ndone", "thwha", "heder", "iónja"],
    "length": ["hrend", "nedti", "iónta", "ningn"],
    "detail": ["reant", "nndti", "ellet", "onlye"],
}
POSITION = {
    "premium": ["einsc", "aiaux", "schte", "thsti", "erstt", "cióni"],
    "trend": ["thlya", "rntth", "honha", "eauqu", "nouti", "ererb"],
    "useful": ["ontre", "thhew", "hanbl", "onshe", "hheha", "edone"],
    "value": ["tion", "thin", "ntione", "thhein", "ciónos", "thtiin"],
    "unique": ["thshin", "ciónrr", "schung", "thbleo", "erthin", "thatan"],
    "basic": ["inkeit", "hantio", "tion", "heheh", "gtion", "blebl"],
    "young": ["erer", "onon", "thth", "anan", "eauou", "lichk"],
    "minimal": ["hewh", "atth", "ingin", "stst", "ención", "zzqq"],
}
FACTOR = {
    "design": ["étion", "hathe", "nenst", "thndh", "rlich", "hrein", "erate"],
    "quality": ["hesti", "nbleo", "hings", "nhati", "thhes", "ntiin", "reshe"],
    "price": ["heaea", "hesin", "onhee", "erach", "haner", "sment", "erent"],
    "size": ["nshat", "erest", "iónar", "rhati", "aiier", "honan", "erheo"],
    "colour": ["onwhe", "ndone", "thwha", "heder", "iónja", "hrend", "nenti"],
    "delivery": ["nedti", "iónta", "theas", "ningn", "reant", "nndti"],
    "brand": ["ellet", "onlye", "einsc", "aiaux", "schte"],
}
RADAR = ["design", "quality", "price", "size", "colour"]
AGE = {
    "teens": ["hwhth", "nathe", "lichz", "éaux", "istth"],
    "twenties": ["atthe", "ones", "unden", "queau", "ssch", "rear"],
    "thirties": ["inter", "stere", "keitd", "ouéau", "ació", "thear"],
    "forties": ["ereth", "anand", "gein", "lesle", "mente"],
}
BODY = {
    "slim": ["thand", "heit", "desau", "ione"],
    "full": ["onand", "lichs", "aulich", "iónes", "ouque"],
    "plain": ["hand", "reine", "eleau", "ósal"],
}
NEEDS = ["Ofthe", "nderth", "hathat", "ciónla", "schin", "eauen", "tionth", "erhand"]
STYLE = {
    "hot": ["hot", "ho"],
    "ring": ["ring", "rod", "bolt"],
    "gear": ["gear", "gizmo"],
    "plate": ["plate"],
    "lace": ["lace", "frill"],
    "old": ["old", "cold"],
}
COLOR = {"red": ["red"], "blue": ["blue", "lue b"], "new": ["new", "e"], "black": ["black"]}
STOP = ["the", "of", "and", "de", "to", "in", "la", "der", "is", "that"]
THEME_PATTERN = r"\p{L}+"
MESSAGES = {
    ("design", "lyea"): "{pct}% like the design",
    ("price", "ever"): "good price",
    ("joy", "avec"): "joy for {pct}% of buyers",
}
MESSAGE_DEFAULT = "{category}: {pct}% content"
SUGGESTIONS = {("size", "keit"): "check the size table", ("price", "rren"): "review the price"}
SUGGESTION_DEFAULT = "improve {category}"
POSITION_TEXTS = {"value": "show the price", "trend": "show the season", "basic": "widen the line"}
AGE_TEXTS = {"teens": "school", "twenties": "campus", "thirties": "office"}

POSITIVE_LEX, NEGATIVE_LEX = Lexicon.of(POSITIVE), Lexicon.of(NEGATIVE)
IMPROVEMENT_LEX, FACTOR_LEX = Lexicon.of(IMPROVEMENT), Lexicon.of(FACTOR)
POSITION_LEX, AGE_LEX, BODY_LEX = Lexicon.of(POSITION), Lexicon.of(AGE), Lexicon.of(BODY)
STYLE_LEX, COLOR_LEX = Lexicon.of(STYLE), Lexicon.of(COLOR)

AS_OF = "2024-01-20 00:00:00"
KEY = ["review_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tasks that the texts of a given table, which is one file, are dealt to: at least so many, and some for each core.
TEXT_PARTITIONS, TASKS_PER_CORE = 16, 4


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The columns of a given table with texts, dealt out as a user of the readers would."""
    tasks = max(TEXT_PARTITIONS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return dealt(table(spark, sf, name).select(*columns), tasks)


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as products on offer; all line item columns together order the rows."""
    items, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    return joined.select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_discount") * 100, 0).alias("discount_pct"),
        *items.columns,
    )


OFFER_KEY = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
OFFERS_SQL = """offers AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, p_brand AS brand, p_name AS name,
         l_extendedprice AS price, round(l_discount * 100, 0) AS discount_pct, l.*
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""
OFFER_KEY_SQL = ", ".join(OFFER_KEY)


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") % 40).cast("double").alias("discount_pct"),
    )


CATALOGUE_SQL = """catalogue AS (
  SELECT p_partkey AS product_id, p_brand AS brand, p_name AS name, p_retailprice AS price,
         CAST(p_size % 40 AS DOUBLE) AS discount_pct
  FROM part)"""


def reviews(spark: SparkSession, sf: str, brand: str = "source") -> DataFrame:
    """Documents as reviews; images come from the labels of some of them."""
    docs, labels = texts(spark, sf, "documents", "doc_id", "text", "source"), table(spark, sf, "labels")
    flags = labels.select(
        F.col("doc_id").alias("labelled"), F.when(F.col("quality") == 1, "Y").otherwise("N").alias("has_image")
    )
    rows = docs.join(flags, docs.doc_id == flags.labelled, "left")
    number = F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string"))
    return rows.select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 50).cast("string").alias("product_id"),
        (F.col("source") if brand == "source" else number).alias("brand"),
        "text",
        (F.col("doc_id") % 7 + 1).cast("int").alias("page_number"),
        "has_image",
        F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 11).cast("double")).alias("helpful_count"),
    )


def brand_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the brands of the catalogue."""
    return reviews(spark, sf, "number")


def _reviews_sql(name: str, brand: str) -> str:
    return f"""{name} AS (
  SELECT d.doc_id AS review_id, CAST(d.doc_id % 50 AS VARCHAR) AS product_id, {brand} AS brand,
         text, CAST(d.doc_id % 7 + 1 AS INTEGER) AS page_number,
         CASE WHEN quality = 1 THEN 'Y' WHEN quality IS NOT NULL THEN 'N' END AS has_image,
         CASE WHEN d.doc_id % 5 > 0 THEN CAST(d.doc_id % 11 AS DOUBLE) END AS helpful_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


REVIEWS_SQL = _reviews_sql("reviews", "source")
BRAND_REVIEWS_SQL = _reviews_sql("reviews", "'Brand#' || CAST(d.doc_id % 25 + 1 AS VARCHAR)")


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as reviews: several pages per product."""
    return texts(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("string").alias("product_id"), F.col("turn").alias("page_number"),
        F.col("role").alias("brand"), "text",
    )


THREADS_SQL = """threads AS (
  SELECT CAST(conv_id AS VARCHAR) AS product_id, turn AS page_number, role AS brand, text
  FROM conversations)"""


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dated reviews; the event number is the page order, not quite newest first."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("product_id"),
        F.col("ts").alias("date"), F.col("value").alias("helpful_count"),
        (F.col("event_id") * 7919 % 1000).alias("page_number"), "event_type",
    )


DATED_SQL = """dated AS (
  SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS product_id, ts AS date,
         value AS helpful_count, event_id * 7919 % 1000 AS page_number, event_type
  FROM events)"""


def lex_sql(name: str, words: Mapping[str, Sequence[str]]) -> str:
    """Lexicon as a CTE (ord, cat_ord, category, keyword)."""
    rows, n = [], 0
    for i, (category, keywords) in enumerate(words.items()):
        for keyword in keywords:
            rows.append(f"({n}, {i}, '{category}', '{keyword}')")
            n += 1
    return f"{name}(ord, cat_ord, category, keyword) AS (VALUES {', '.join(rows)})"


SCORED_SQL = f"""{lex_sql("pos_lex", POSITIVE)},
{lex_sql("neg_lex", NEGATIVE)},
pos_hits AS (
  SELECT review_id, p.*, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS k
  FROM reviews, pos_lex p WHERE contains(text, keyword)),
neg_hits AS (
  SELECT review_id, n.*, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS k
  FROM reviews, neg_lex n WHERE contains(text, keyword)),
pos_scores AS (
  SELECT review_id, count(*) AS s,
         string_agg(category || ':' || keyword, ', ' ORDER BY ord) FILTER (k <= 3) AS reasons
  FROM pos_hits GROUP BY review_id),
neg_scores AS (
  SELECT review_id, count(*) AS s,
         string_agg(category || ':' || keyword, ', ' ORDER BY ord) FILTER (k <= 3) AS reasons
  FROM neg_hits GROUP BY review_id),
scored AS (
  SELECT r.*, CAST(coalesce(p.s, 0) AS INTEGER) AS positive_score,
         CAST(coalesce(n.s, 0) AS INTEGER) AS negative_score,
         CASE WHEN coalesce(p.s, 0) > coalesce(n.s, 0) THEN 'positive'
              WHEN coalesce(n.s, 0) > coalesce(p.s, 0) THEN 'negative' ELSE 'neutral' END AS sentiment,
         coalesce(p.reasons, '') AS positive_reasons, coalesce(n.reasons, '') AS negative_reasons
  FROM reviews r LEFT JOIN pos_scores p ON r.review_id = p.review_id
                 LEFT JOIN neg_scores n ON r.review_id = n.review_id)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
