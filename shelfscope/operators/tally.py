"""Counting and summing what reviews hold, for all groups in one pass.

Every review is turned into a few small cells (section, category, keyword, weight); per group, equal
cells are counted and their weights added with partial aggregation, so a task sends at most one row per
group and distinct cell, however many reviews the group has. Means are a cell's weight over its count;
distinct values are cells that carry the value as keyword. The second aggregation sees a table bounded
by groups times lexicon entries (and distinct values, where asked for) and folds it into one row per
group; lists in it are bounded by the lexicon.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.matching import occurrence_weight, present, quoted
from shelfscope.lexicon import Lexicon

CELL = "struct<section:string,category:string,keyword:string,weight:double>"
CELL_TYPE = f"array<{CELL}>"


def cell(
    section: str, category: Column | None = None, keyword: Column | None = None, weight: Column | None = None
) -> Column:
    blank = F.lit("")
    return F.struct(
        F.lit(section).alias("section"),
        (blank if category is None else category).alias("category"),
        (blank if keyword is None else keyword).alias("keyword"),
        (F.lit(0.0) if weight is None else weight.cast("double")).alias("weight"),
    )


def one(section: str, weight: Column | None = None) -> Column:
    return F.array(cell(section, weight=weight))


def no_cells() -> Column:
    return F.array().cast(CELL_TYPE)


def measure_cells(section: str, value: Column) -> Column:
    """A cell weighing `value` for each review that has one."""
    return F.when(value.isNotNull(), one(section, value)).otherwise(no_cells())


def flag_cells(section: str, flag: Column) -> Column:
    """A cell for each review for which `flag` holds."""
    return F.when(flag, one(section)).otherwise(no_cells())


def value_cells(section: str, value: Column) -> Column:
    """A cell naming `value` for each review that has one: its distinct values are distinct cells."""
    return F.when(value.isNotNull(), F.array(cell(section, keyword=value.cast("string")))).otherwise(no_cells())


def hit_cells(section: str, hits: Column) -> Column:
    return F.transform(hits, lambda h: cell(section, keyword=h))


def category_cells(section: str, keywords: Sequence[str], lexicon: Lexicon) -> Column:
    """One cell per category mentioned by the hits of the row."""
    items = [
        (counted, f"named_struct('section', '{section}', 'category', {quoted(c)}, 'keyword', '', 'weight', 0D)")
        for c, counted in lexicon.categories
    ]
    return present(keywords, items, CELL)


def reason_cells(polarity: str) -> Column:
    """One cell for the review and one per stored reason, when the review has the sentiment."""
    reasons = F.coalesce(
        F.transform(F.col(f"{polarity}_reasons"),
                    lambda r: cell(f"{polarity}_reason", r["category"], r["keyword"])),
        no_cells(),
    )
    cells = F.concat(one(polarity), reasons)
    return F.when(F.col("sentiment") == polarity, cells).otherwise(no_cells())


def profile(df: DataFrame, by: Sequence[str], cells: Column, aggregates: dict[str, Column]) -> DataFrame:
    """One row per group (missing group keys dropped) with the given aggregates over cells."""
    for key in by:
        df = df.filter(F.col(key).isNotNull())
    counted = (
        df.select(*by, F.inline(cells))
        .groupBy(*by, "section", "category", "keyword")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    )
    return counted.groupBy(*by).agg(*[column.alias(name) for name, column in aggregates.items()])


def total(section: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("section") == section, F.col("n"))), F.lit(0))


def mean(section: str) -> Column:
    """Mean weight of a section's cells; NULL without cells."""
    here = F.col("section") == section
    return F.sum(F.when(here, F.col("weight"))) / F.nullif(F.sum(F.when(here, F.col("n"))), F.lit(0))


def distinct(section: str) -> Column:
    """Number of different cells of a section."""
    return F.count_if(F.col("section") == section)


def reasons(polarity: str, n: int | None = None) -> Column:
    """Reasons by count (descending), then category and keyword."""
    item = F.struct(
        (-F.col("n")).alias("order"), "category", "keyword", F.col("n").alias("frequency")
    )
    ranked = F.array_sort(F.collect_list(F.when(F.col("section") == f"{polarity}_reason", item)))
    return ranked if n is None else F.slice(ranked, 1, n)


def presences(section: str, lexicon: Lexicon) -> Column:
    """Categories that occur, by number of reviews (descending), then lexicon order."""
    cat_ord = F.lit(len(lexicon.names))
    for i, category in enumerate(lexicon.names):
        cat_ord = F.when(F.col("category") == category, i).otherwise(cat_ord)
    item = F.struct((-F.col("n")).alias("order"), cat_ord.alias("cat_ord"), "category", "n")
    return F.array_sort(F.collect_list(F.when(F.col("section") == section, item)))


def occurrence_scores(
    section: str, keywords: Sequence[str], lexicon: Lexicon, present_only: Collection[str] = ()
) -> Column:
    """All categories by number of occurrences (descending), then lexicon order."""
    items = []
    for i, (category, counted) in enumerate(lexicon.categories):
        weight = occurrence_weight(keywords, counted, present_only=present_only)
        score = f"coalesce(sum(CASE WHEN section = '{section}' THEN n * ({weight}) END), 0)"
        items.append(
            f"named_struct('order', -{score}, 'cat_ord', {i}, 'category', {quoted(category)}, 'score', {score})"
        )
    return F.expr(f"array_sort(array({', '.join(items)}))")
