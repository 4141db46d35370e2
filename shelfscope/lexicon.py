"""Keyword lexicons: ordered categories of ordered keywords, passed to operators as parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfscope import fixed_values as fv

LEXICON_SCHEMA = "lexicon string, category string, cat_ord int, keyword string, kw_ord int"

MOST_ENTRIES = 5_000


@dataclass(frozen=True)
class Lexicon:
    """Categories in order, each with its keywords in order (a keyword may sit in several)."""

    categories: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, words: Mapping[str, Sequence[str]]) -> Lexicon:
        return cls(tuple((c, tuple(k for k in ks if k)) for c, ks in words.items()))

    @classmethod
    def from_frame(cls, df: DataFrame, lexicon: str, most: int = MOST_ENTRIES) -> Lexicon:
        """Read one lexicon from a dimension table. A lexicon is literals in expressions, so a table of more
        than `most` entries is refused; `operators.large_lexicon` takes such a table as it is."""
        words: dict[str, list[str]] = {}
        rows = df.filter(df.lexicon == lexicon).orderBy("cat_ord", "kw_ord").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"lexicon {lexicon} has more than {most} entries")
        for row in rows:
            words.setdefault(row.category, []).append(row.keyword)
        return cls.of(words)

    def to_frame(self, spark: SparkSession, lexicon: str) -> DataFrame:
        rows = [
            (lexicon, category, i, keyword, j)
            for i, (category, keywords) in enumerate(self.categories)
            for j, keyword in enumerate(keywords)
        ]
        return spark.createDataFrame(rows, LEXICON_SCHEMA)

    @property
    def names(self) -> list[str]:
        return [category for category, _ in self.categories]

    @property
    def entries(self) -> list[tuple[str, str]]:
        """(category, keyword) pairs in lexicon order."""
        return [(c, k) for c, ks in self.categories for k in ks]

    @property
    def keywords(self) -> list[str]:
        """Distinct keywords in lexicon order."""
        return unique(k for _, k in self.entries)

    def __len__(self) -> int:
        return len(self.entries)


def unique(items: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(items))


POSITIVE = Lexicon.of(fv.POSITIVE_WORDS)
NEGATIVE = Lexicon.of(fv.NEGATIVE_WORDS)
IMPROVEMENT = Lexicon.of(fv.IMPROVEMENT_WORDS)
POSITION = Lexicon.of(fv.POSITION_WORDS)
FACTOR = Lexicon.of(fv.FACTOR_WORDS)
AGE = Lexicon.of(fv.AGE_WORDS)
BODY = Lexicon.of(fv.BODY_WORDS)
STYLE = Lexicon.of(fv.STYLE_WORDS)
STYLE_FULL = Lexicon.of(fv.STYLE_WORDS_FULL)
COLOR = Lexicon.of(fv.COLOR_WORDS)
