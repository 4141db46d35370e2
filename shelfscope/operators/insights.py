"""Reasons, improvement topics, themes, customer needs and message texts from scored reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.functions.matching import categories_of, contains_any, with_hits
from shelfscope.functions.values import extract_keywords, percent_format
from shelfscope.lexicon import IMPROVEMENT, Lexicon
from shelfscope.operators.ordering import first_n_per_group
from shelfscope.operators.sentiment import pct
from shelfscope.operators.tally import (
    category_cells,
    one,
    presences,
    profile,
    reason_cells,
    reasons,
    total,
)

Templates = Mapping[tuple[str, str], str]


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def top_reasons(scored: DataFrame, polarity: str, n: int = 10, by: str | None = None) -> DataFrame:
    """Most frequent stored reasons of the reviews of one sentiment and their share of these
    reviews; per group when ``by`` is given."""
    keys = _keys(by)
    wide = profile(
        scored.filter(F.col("sentiment") == polarity), keys, reason_cells(polarity),
        {"total": total(polarity), "reasons": reasons(polarity, n)},
    )
    return (
        wide.select(*keys, "total", F.posexplode("reasons").alias("pos", "r"))
        .select(
            *keys, "r.category", "r.keyword", "r.frequency",
            pct(F.col("r.frequency"), F.col("total")).alias("percentage"),
            (F.col("pos") + 1).alias("rn"),
        )
    )


def _fill(template: Column, category: Column, percentage: Column | None) -> Column:
    text = F.replace(template, F.lit("{category}"), category)
    if percentage is None:
        return text
    return F.replace(text, F.lit("{pct}"), percent_format(percentage))


def template_text(
    category: Column, keyword: Column, percentage: Column | None, templates: Templates, default: str
) -> Column:
    """Template for (category, keyword), else the default, with category and percent filled in.
    The template table is a parameter of a few rows, so it is a literal lookup, not a join."""
    chosen = F.lit(default)
    if templates:
        pairs = [F.lit(v) for (c, k), t in templates.items() for v in (f"{c}\n{k}", t)]
        found = F.create_map(*pairs)[F.concat(category, F.lit("\n"), keyword)]
        chosen = F.coalesce(found, F.lit(default))
    return _fill(chosen, category, percentage)


def marketing_message(
    df: DataFrame, templates: Templates = fv.MESSAGE_TEMPLATES, default: str = fv.MESSAGE_DEFAULT
) -> DataFrame:
    """Adds a message to (category, keyword, percentage) rows."""
    text = template_text(
        F.col("category"), F.col("keyword"), F.col("percentage"), templates, default
    )
    return df.withColumn("message", text)


def improvement_suggestion(
    df: DataFrame, templates: Templates = fv.SUGGESTION_TEMPLATES, default: str = fv.SUGGESTION_DEFAULT
) -> DataFrame:
    """Adds a suggestion to (category, keyword) rows."""
    text = template_text(F.col("category"), F.col("keyword"), None, templates, default)
    return df.withColumn("suggestion", text)


def top_strengths(scored: DataFrame, n: int = 5, by: str | None = None, **texts) -> DataFrame:
    return marketing_message(top_reasons(scored, "positive", n, by), **texts)


def top_weaknesses(scored: DataFrame, n: int = 5, by: str | None = None, **texts) -> DataFrame:
    return improvement_suggestion(top_reasons(scored, "negative", n, by), **texts)


def improvement_topics(
    scored: DataFrame, lexicon: Lexicon = IMPROVEMENT, by: str | None = None
) -> DataFrame:
    """Topics of negative reviews: number and share of the negative reviews holding any keyword of
    the topic, topics that do not occur left out."""
    keys = _keys(by)
    negative = with_hits(scored.filter(F.col("sentiment") == "negative"), lexicon.keywords)
    topics = category_cells("topic", lexicon.keywords, lexicon)
    wide = profile(
        negative, keys, F.concat(one("all"), topics),
        {"total": total("all"), "topics": presences("topic", lexicon)},
    )
    return wide.select(*keys, "total", F.posexplode("topics").alias("pos", "t")).select(
        *keys, "t.category", F.col("t.n").alias("count"),
        pct(F.col("t.n"), F.col("total")).alias("percentage"), (F.col("pos") + 1).alias("rn"),
    )


def topic_examples(
    scored: DataFrame,
    key: Sequence[str],
    lexicon: Lexicon = IMPROVEMENT,
    n: int = 3,
    chars: int = 100,
    by: str | None = None,
) -> DataFrame:
    """Beginning of the first n negative reviews of each topic."""
    keys = _keys(by)
    negative = scored.filter(F.col("sentiment") == "negative")
    return category_examples(negative, keys, key, lexicon, n, chars)


def category_examples(
    df: DataFrame, keys: Sequence[str], key: Sequence[str], lexicon: Lexicon, n: int, chars: int
) -> DataFrame:
    """First n text beginnings per group and category; texts are cut before anything is shuffled."""
    found = categories_of(lexicon.keywords, lexicon)
    rows = with_hits(df, lexicon.keywords).select(
        *keys, *[c for c in key if c not in keys],
        F.substring("text", 1, chars).alias("text"), F.explode(found).alias("category"),
    )
    first = first_n_per_group(rows, [*keys, "category"], list(key), n, few_groups=not keys)
    return first.select(*keys, "category", "rn", "text")


def _words(
    rows: DataFrame, keys: Sequence[str], stop_words: Sequence[str], pattern: str
) -> DataFrame:
    for name in keys:
        rows = rows.filter(F.col(name).isNotNull())
    return (
        rows.select(*keys, F.explode(extract_keywords(F.col("text"), pattern)).alias("keyword"))
        .filter(~F.col("keyword").isin(list(stop_words)))
        .groupBy(*keys, "keyword")
        .agg(F.count("*").alias("n"))
    )


def common_themes(
    scored: DataFrame,
    sentiment: str = "all",
    n: int = 20,
    stop_words: Sequence[str] = fv.STOP_WORDS,
    pattern: str = fv.THEME_PATTERN,
) -> DataFrame:
    """Most frequent words of the reviews of one sentiment (or all), stop words removed."""
    rows = scored if sentiment == "all" else scored.filter(F.col("sentiment") == sentiment)
    return _words(rows, [], stop_words, pattern).orderBy(F.desc("n"), "keyword").limit(n)


def product_themes(
    scored: DataFrame,
    n: int = 10,
    stop_words: Sequence[str] = fv.STOP_WORDS,
    pattern: str = fv.THEME_PATTERN,
) -> DataFrame:
    """Most frequent words per product, for positive and for negative reviews."""
    keys = ["product_id", "sentiment"]
    opinions = scored.filter(F.col("sentiment").isin("positive", "negative"))
    counted = _words(opinions, keys, stop_words, pattern)
    return first_n_per_group(counted, keys, [F.desc("n"), "keyword"], n)


def customer_needs(
    reviews: DataFrame,
    key: Sequence[str],
    words: Sequence[str] = fv.NEED_WORDS,
    n: int = 3,
    by: str | None = None,
) -> DataFrame:
    """First n sentences holding each need word. A sentence ends at a full stop and does not run
    over the end of a review."""
    keys = _keys(by)
    needed = F.array_compact(
        F.array(*[F.when(F.contains("sentence", F.lit(w)), F.lit(w)) for w in words])
    )
    carried = [*keys, *[c for c in key if c not in keys]]
    sentences = (
        reviews.filter(contains_any(F.col("text"), words))
        .select(*carried, F.posexplode(F.split("text", r"\.")).alias("sentence_no", "sentence"))
        .select(*carried, "sentence_no", "sentence", F.explode(needed).alias("keyword"))
    )
    first = first_n_per_group(sentences, [*keys, "keyword"], [*key, "sentence_no"], n, few_groups=not keys)
    return first.select(*keys, "keyword", "rn", "sentence")
