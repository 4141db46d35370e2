"""Ranks in a global order without one task that sees all rows: range counts and offsets.

A bounded sample of the sort keys (the rows of least hash, so the same ones in every run) gives range
boundaries; rows are counted per range in one pass with partial aggregation. Before a range stand the
rows of the ranges before it, so a rank is known within its range plus an offset. Keys are any number of
columns of any comparable types, each ascending or descending, missing values first or last.

What the driver holds is the boundaries and a count per range: `ranges` rows each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

RANGES = 64
#: Sampled keys per range.
SAMPLED = 32
#: Boundaries that a row is compared with at a time.
STRIDE = 8


@dataclass(frozen=True)
class Key:
    """A sort column."""

    column: str
    ascending: bool = True
    nulls_last: bool = True

    def order(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()

    def before(self, a: Column, b: Column) -> Column:
        lower = a < b if self.ascending else a > b
        return (
            F.when(a.isNull(), F.lit(not self.nulls_last) & b.isNotNull())
            .when(b.isNull(), F.lit(self.nulls_last)).otherwise(lower)
        )


@dataclass(frozen=True)
class Ranges:
    """Boundaries of a table's rows in the order of `keys`: range k holds the rows from boundary k - 1 on."""

    keys: tuple[Key, ...]
    types: dict[str, str]
    bounds: tuple[Row, ...]

    def literal(self, bound: Row) -> dict[str, Column]:
        return {k.column: F.lit(bound[k.column]).cast(self.types[k.column]) for k in self.keys}

    def _before(self, bound) -> Column:
        """Whether the row stands before `bound` (a column per key column)."""
        result = F.lit(False)
        for key in reversed(self.keys):
            row, other = F.col(key.column), bound[key.column]
            result = key.before(row, other) | (row.eqNullSafe(other) & result)
        return result

    def before(self, k: int) -> Column:
        return self._before(self.literal(self.bounds[k]))

    def number(self) -> Column:
        """The range of a row: how many boundaries stand at it or before it, by coarse steps, then fine ones."""
        if not self.bounds:
            return F.lit(0)
        named = [F.struct(*[c.alias(name) for name, c in self.literal(b).items()]) for b in self.bounds]
        reached = lambda some: F.size(F.filter(some, lambda b: ~self._before(b)))
        coarse = reached(F.array(*named[STRIDE - 1 :: STRIDE])) * STRIDE if len(named) >= STRIDE else F.lit(0)
        return F.element_at(F.transform(F.array(coarse), lambda c: c + reached(F.slice(F.array(*named), c + 1, STRIDE - 1))), 1)

    def within(self, first: int, last: int) -> Column:
        """Whether a row is in one of the ranges first to last: plain comparisons with two boundaries."""
        inside = F.lit(True)
        if first > 0:
            inside = inside & ~self.before(first - 1)
        if last < len(self.bounds):
            inside = inside & self.before(last)
        return inside


def sampled(df: DataFrame, columns: Sequence[str], ranges: int) -> DataFrame:
    """Key rows of least hash, at most `ranges` x SAMPLED."""
    return df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(ranges * SAMPLED)


def in_order(rows: list[Row], keys: Sequence[Key]) -> list[Row]:
    """A bounded list of rows sorted as Spark sorts: NaN after all numbers, missing values where the key says."""
    for key in reversed(keys):
        none = [r for r in rows if r[key.column] is None]
        some = [r for r in rows if r[key.column] is not None]
        value = lambda r, c=key.column: (isinstance(r[c], float) and math.isnan(r[c]), r[c])
        some.sort(key=value, reverse=not key.ascending)
        rows = some + none if key.nulls_last else none + some
    return rows


def ranges_of(df: DataFrame, keys: Sequence[Key], ranges: int = RANGES, sample: list[Row] | None = None) -> Ranges:
    columns = [k.column for k in keys]
    rows = in_order(sampled(df, columns, ranges).collect() if sample is None else sample, keys)
    step = max(1, len(rows) // ranges)
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    return Ranges(tuple(keys), types, tuple(rows[step::step][: ranges - 1]))


def page_at(
    df: DataFrame, n: int, keys: Sequence[Key], size: int = 20, ranges: int = RANGES, enough: int = 100_000
) -> DataFrame:
    """Rows of page n (from 1) in a total order, however deep, by rank selection.

    Ranges are counted, and only the ones that hold the page are kept, until they have `enough` rows or
    fewer; those are sorted. Each round reads the input twice (keys only) and keeps about 1 in `ranges` rows.
    Runs jobs when called. Rows that equal in all keys cannot be divided further and are sorted together.
    """
    part, skipped = df, (n - 1) * size
    while True:
        cut = ranges_of(part, keys, ranges)
        counts = {r["_range"]: r["_rows"] for r in part.groupBy(cut.number().alias("_range")).agg(F.count("*").alias("_rows")).collect()}
        rows = [counts.get(k, 0) for k in range(len(cut.bounds) + 1)]
        total = sum(rows)
        if skipped >= total:
            return df.limit(0)
        upto, before = 0, []
        for count in rows:
            before.append(upto)
            upto += count
        last_row = min(skipped + size, total) - 1
        first = max(k for k, b in enumerate(before) if b <= skipped)
        last = max(k for k, b in enumerate(before) if b <= last_row)
        kept = sum(rows[first : last + 1])
        part, skipped = part.filter(cut.within(first, last)), skipped - before[first]
        if kept <= enough or kept == total:
            break
    return part.orderBy(*[k.order() for k in keys]).offset(skipped).limit(size)


def ranked(df: DataFrame, ranks: dict[str, Sequence[Key]], ranges: int = RANGES) -> DataFrame:
    """`df` with a rank (from 1) for each of several total orders.

    One sample gives the boundaries of all orders, one pass counts all ranges; each rank is then a window
    within its ranges plus the offset of the range. `df` is read once for each of these, so store what is dear.
    Runs jobs when called.
    """
    columns = list(dict.fromkeys(k.column for keys in ranks.values() for k in keys))
    sample = sampled(df, columns, ranges).collect()
    cuts = {name: ranges_of(df, keys, ranges, sample) for name, keys in ranks.items()}
    cells = F.array(*[F.struct(F.lit(name).alias("_rank"), cut.number().alias("_range")) for name, cut in cuts.items()])
    counted = df.select(F.inline(cells)).groupBy("_rank", "_range").agg(F.count("*").alias("_rows")).collect()
    for name, cut in cuts.items():
        rows = {r["_range"]: r["_rows"] for r in counted if r["_rank"] == name}
        offsets, upto = [], 0
        for k in range(len(cut.bounds) + 1):
            offsets.append(upto)
            upto += rows.get(k, 0)
        window = Window.partitionBy("_range").orderBy(*[k.order() for k in cut.keys])
        offset = F.get(F.lit(offsets).cast("array<long>"), F.col("_range"))
        df = (
            df.withColumn("_range", cut.number())
            .withColumn(name, (F.row_number().over(window) + offset).cast("int"))
            .drop("_range")
        )
    return df
