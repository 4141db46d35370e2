"""Column expressions that find lexicon keywords in text.

Which keywords a text holds is a filter over the literal list of them, one substring search each, as long
as they are few. Which of many it holds, and how often they occur, is read off one regular expression in a
lookahead, which tries every position and yields the longest keyword there; shorter ones at the same
position are prefixes of it.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.lexicon import Lexicon, unique

ENTRY_TYPE = "struct<category:string,keyword:string>"

#: Up to so many keywords, a search for each costs less than one walk over the text for all.
FEW_KEYWORDS = 80


def _prefix_pattern(words: Sequence[str]) -> str:
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])
    branches = [re.escape(head) + _prefix_pattern(rest) for head, rest in tails.items()]
    if len(branches) < 2 and "" not in words:
        return "".join(branches)
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "") if branches else ""


def _any_of(letters: Iterable[str]) -> str:
    return "[" + "".join(sorted({re.escape(x) for x in letters})) + "]"


def _guard(words: Sequence[str], most: int) -> str:
    depth = min(most, *(len(w) for w in words), most)
    return f"(?={''.join(_any_of(w[i] for w in words) for i in range(depth))})"


def _branches(words: Sequence[str], heads: Sequence[str]) -> str:
    """The keywords with these first letters, halved down to two letters, each half behind a look at them."""
    own = [w for w in words if w[0] in heads]
    if len(heads) <= 2:
        return _guard(own, 4) + _prefix_pattern(own)
    middle = len(heads) // 2
    return "|".join(f"(?={_any_of(part)})(?:{_branches(own, part)})" for part in (heads[:middle], heads[middle:]))


def keyword_pattern(keywords: Iterable[str]) -> str:
    """Regular expression whose group 1 is the longest keyword starting at a position. A guard on
    the first characters rejects most positions before any keyword is tried."""
    words = unique(k for k in keywords if k)
    return f"{_guard(words, 3)}(?=({_branches(words, sorted({w[0] for w in words}))}))"


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Array with the longest keyword at every position of the text where one starts."""
    if not keywords:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(keyword_pattern(keywords)), F.lit(1))


def overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def occurrences(text: Column, keyword: str) -> Column:
    """Number of non-overlapping occurrences of one keyword."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))
    return F.when(F.contains(text, F.lit(keyword)), (removed / len(keyword)).cast("int")).otherwise(0)


def _apart(word: str, present_only: Collection[str]) -> bool:
    return overlaps_itself(word) and word not in present_only


def occurrence_hits(text: Column, keywords: Sequence[str], present_only: Collection[str] = ()) -> Column:
    """As keyword_hits, but a keyword that can overlap itself is repeated only as often as it
    occurs without overlap; count with ``occurrence_weight``. Keywords of ``present_only`` are not
    counted by anybody, so they stay in the one walk over the text."""
    plain = [k for k in keywords if not _apart(k, present_only)]
    hits = [keyword_hits(text, plain)]
    hits += [
        F.array_repeat(F.lit(k), occurrences(F.coalesce(text, F.lit("")), k))
        for k in keywords
        if _apart(k, present_only)
    ]
    return F.concat(*hits)


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hit_weight(key: str, counted: Sequence[str], present_only: Collection[str] = ()) -> int:
    """How many of the counted keywords one occurrence hit stands for."""
    if _apart(key, present_only):
        return sum(c == key for c in counted)
    return sum(key.startswith(c) and not overlaps_itself(c) for c in counted)


def occurrence_weight(
    keywords: Sequence[str], counted: Sequence[str], hit: str = "keyword", present_only: Collection[str] = ()
) -> str:
    """SQL: how many of the counted keywords one occurrence hit (over ``keywords``) stands for."""
    hits: dict[int, list[str]] = {}
    for key in unique(keywords):
        weight = hit_weight(key, counted, present_only)
        if weight:
            hits.setdefault(weight, []).append(quoted(key))
    whens = [f"WHEN {hit} IN ({', '.join(keys)}) THEN {weight}" for weight, keys in hits.items()]
    return f"CASE {' '.join(whens)} ELSE 0 END" if whens else "0"


def present(
    keywords: Sequence[str], items: Sequence[tuple[Sequence[str], str]], dtype: str, hits: str = "_hits"
) -> Column:
    """Array of the items (SQL) any of whose keywords is among the hits, in the given order. A
    longer keyword among the hits stands for the keywords it starts with.

    Each hit is looked up in a literal map to the places of its items, so the work follows the hits of
    a row, not the items; a condition per item makes a method too long to be compiled at run time. It is
    written as SQL text, for one expression per keyword built through the Column API takes seconds of
    driver time.
    """
    none = f"cast(array() AS array<{dtype}>)"
    places = {k: [i for i, (wanted, _) in enumerate(items) if any(k.startswith(w) for w in wanted)] for k in unique(keywords)}
    known = [f"{quoted(k)}, array({', '.join(map(str, own))})" for k, own in places.items() if own]
    if not known:
        return F.expr(none)
    found = f"flatten(transform({hits}, h -> coalesce(map({', '.join(known)})[h], cast(array() AS array<int>))))"
    listed = f"cast(array({', '.join(item for _, item in items)}) AS array<{dtype}>)"
    return F.expr(f"transform(array_sort(array_distinct({found})), i -> {listed}[i])")


def entries_of(keywords: Sequence[str], lexicon: Lexicon) -> Column:
    """Lexicon entries standing behind the hits of the row, once each, in lexicon order."""
    items = [
        ([k], f"named_struct('category', {quoted(c)}, 'keyword', {quoted(k)})")
        for c, k in lexicon.entries
    ]
    return present(keywords, items, ENTRY_TYPE)


def categories_of(keywords: Sequence[str], lexicon: Lexicon) -> Column:
    """Names of the categories with at least one keyword among the hits, in lexicon order."""
    return present(keywords, [(counted, quoted(c)) for c, counted in lexicon.categories], "string")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator.

    The optimizer copies projected expressions into the filters and expressions that use them. For
    a walk over the text that would mean one walk per use, while nothing is copied past a generator.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def contained(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords that the text holds, once each; missing text holds none."""
    words = unique(k for k in keywords if k)
    if not words:
        return F.array().cast("array<string>")
    known = F.expr(f"array({', '.join(map(quoted, words))})")
    return F.filter(known, lambda k: F.coalesce(F.contains(text, k), F.lit(False)))


def with_hits(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Adds the keywords that the text holds as ``_hits``; of many keywords, one that another one starts
    with may be left to it (`present`)."""
    words = unique(k for k in keywords if k)
    text = F.col("text")
    return computed_once(df, _hits=contained(text, words) if len(words) <= FEW_KEYWORDS else F.array_distinct(keyword_hits(text, words)))


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether the text holds any of the keywords; missing text holds none."""
    found = F.lit(False)
    for keyword in unique(keywords):
        found = found | F.contains(text, F.lit(keyword))
    return F.coalesce(found, F.lit(False))
