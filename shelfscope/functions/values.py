"""Small column expressions: number cleaning, formats, tokens, dates, review fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv

NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)$"


def coerce_numeric(col: Column) -> Column:
    """Text to double; anything that is not a plain number (``59,900``, ``30%``, ``1f``, ``NaN``,
    blank) becomes NULL. Surrounding white space is ignored and infinities are kept."""
    text = F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_double(col: Column) -> Column:
    """Numeric column to double with NaN as NULL."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def parse_money_percent(col: Column) -> Column:
    """Display text (``59,900원``, ``30%``) to double. Opt-in: coerce_numeric gives NULL for these."""
    return F.regexp_replace(col.cast("string"), "[^0-9.]", "").try_cast("double")


def text_or_nan(col: Column, compat_nan: bool = False) -> Column:
    """Missing text as '' or, in compatibility mode, as the three letters ``nan``."""
    return F.coalesce(col.cast("string"), F.lit("nan" if compat_nan else ""))


def percent_format(col: Column) -> Column:
    """Whole-number text, halves rounded to even (12.5 -> 12, 13.5 -> 14)."""
    return F.format_string("%.0f", F.bround(col.cast("double"), 0))


def fixed_format(col: Column, digits: int = 1) -> Column:
    """Decimal text such as ``61.3``."""
    return F.format_string(f"%.{digits}f", F.bround(col.cast("double"), digits))


def severity_level(pct: Column) -> Column:
    """1 to 5: one level per 20 percent."""
    return F.least(F.lit(5), F.floor(pct / 20) + 1).cast("int")


def delta_vs_half(pct: Column) -> Column:
    return pct - 50


def extract_keywords(col: Column, pattern: str = fv.THEME_PATTERN, min_len: int = 2) -> Column:
    """Array of the runs of letters of at least ``min_len`` characters."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= min_len)


def _has_any(col: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(col, F.lit(word))
    return found


def parse_review_date(col: Column, as_of: Column, compat: bool = False) -> Column:
    """Review date text to timestamp.

    Relative text counts back from ``as_of`` in hours, days, weeks or 30-day months; absolute text
    is ``yyyy.M.d`` or ``yy.M.d`` with ``.``, ``/`` or ``-``, a time part being dropped. What cannot
    be parsed is NULL. ``compat`` looks for the day word before the week word and gives ``as_of``
    for text that cannot be parsed (a relative text of unknown unit stays NULL).
    """
    relative = F.contains(col, F.lit(fv.AGO_WORD))
    n = F.regexp_extract(col, r"(\d+)", 1).try_cast("int")
    units = [(fv.HOUR_WORDS, 1), (fv.WEEK_WORDS, 7 * 24), (fv.DAY_WORDS, 24), (fv.MONTH_WORDS, 30 * 24)]
    if compat:
        units[1], units[2] = units[2], units[1]
    known = F.lit(False)
    hours = F.lit(None).cast("int")
    for words, factor in reversed(units):
        hours = F.when(_has_any(col, words), n * factor).otherwise(hours)
        known = known | _has_any(col, words)
    ago = F.timestamp_add("HOUR", -hours, as_of)

    head = F.element_at(F.split(F.trim(F.regexp_replace(col, "[./]", "-")), r"\s+"), 1)
    full = F.when(head.rlike(r"^\d\d-"), F.concat(F.lit("20"), head)).otherwise(head)
    day = F.when(
        full.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(full, F.lit("yyyy-M-d"))
    )
    parsed = F.when(relative, ago).otherwise(day)
    if compat:
        parsed = F.when(relative & ~known, parsed).otherwise(F.coalesce(parsed, as_of))
    return parsed


def first_number(col: Column) -> Column:
    """First run of digits as text, NULL when there is none."""
    return F.nullif(F.regexp_extract(col, r"(\d+)", 1), F.lit(""))


def parse_rating(text: Column, stars: Column | None = None) -> Column:
    """Rating as text: the star count when there are stars, else the first filled group of the
    rating pattern, else blank."""
    groups = [F.nullif(F.regexp_extract(text, fv.RATING_PATTERN, i), F.lit("")) for i in range(1, 5)]
    options = groups if stars is None else [F.when(stars > 0, stars.cast("string")), *groups]
    return F.coalesce(*options, F.lit(""))


def helpful_count(label: Column) -> Column:
    """First number of the helpful label; '0' without a label, NULL when the label has no number."""
    return F.when(label.isNull(), F.lit("0")).otherwise(first_number(label))


def has_image(images: Column) -> Column:
    """Y or N from the number of review images."""
    return F.when(F.coalesce(images, F.lit(0)) > 0, "Y").otherwise("N")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
