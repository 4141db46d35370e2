"""Exact quantiles that no single task has to hold all values for.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here
values are counted per ordered bucket (a monotone function of the value: first on a logarithmic
scale, then twice evenly inside a bucket). Only rows of the buckets that hold a wanted rank go on to
the next step. The input is read once: its values go to a narrow table in the shared folder, which
is read once per step and never shuffled as a whole. What the last step groups by value are the
distinct values of one bucket after three cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.session import stored

LOG_STEPS = 1024
LINEAR_STEPS = 4096


def _log_bucket(value: Column) -> Column:
    """Monotone in the value; at most about 1.5 million buckets over all finite doubles."""
    size = F.floor(F.log1p(F.abs(value)) * LOG_STEPS)
    size = F.when(F.abs(value) == float("inf"), F.lit(2**40)).otherwise(size)
    return (F.signum(value) * size).cast("long")


def _linear_bucket(value: Column, first: Column, last: Column) -> Column:
    share = F.try_divide(value - first, last - first)
    return F.coalesce(F.floor(share * LINEAR_STEPS), F.lit(0)).cast("long")


def _bucket_sums(values: DataFrame, path: list[str], bucket: Column) -> DataFrame:
    """Rows, first and last value of each bucket, and the rows before it."""
    level = f"b{len(path)}"
    sums = values.withColumn(level, bucket).groupBy(*path, level).agg(
        F.count("*").alias("rows"), F.min("start").alias("start"),
        F.min("value").alias("first"), F.max("value").alias("last"),
    )
    before = F.sum("rows").over(Window.partitionBy(*path).orderBy(level)) - F.col("rows")
    return sums.withColumn("start", F.col("start") + before)


def _in_wanted(
    values: DataFrame, sums: DataFrame, ranks: DataFrame, path: list[str], bucket: Column
) -> DataFrame:
    """Values of the buckets that hold a wanted rank. The broadcast sides are bounded by the number
    of quantiles asked for."""
    level = f"b{len(path)}"
    holds = F.col("rank").between(F.col("start"), F.col("start") + F.col("rows") - 1)
    kept = sums.join(
        F.broadcast(ranks), (sums["column"] == ranks["wanted_column"]) & holds, "left_semi"
    ).select(*path, level, "start", "first", "last")
    placed = values.withColumn(level, bucket).drop("start", "first", "last")
    return placed.join(F.broadcast(kept), [*path, level])


def cells_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of the numeric columns, stored: the one reading of the input. Writes when called."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return stored(df.select(F.inline(cells)), "cells")


def exact_quantiles(cells: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of stored cells: one row (column, p, value) per column and
    probability. Missing values are skipped; a column without values yields no rows."""
    values = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
        "start", F.lit(0).cast("long")
    )
    path, bucket = ["column"], _log_bucket(F.col("value"))
    sums = stored(_bucket_sums(values, path, bucket), "bucket-sums")
    wanted = stored(
        sums.groupBy("column")
        .agg(F.sum("rows").alias("total"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("at", F.col("p") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        .select(F.col("column").alias("wanted_column"), "p", "at", "rank"),
        "wanted",
    )
    ranks = wanted.select("wanted_column", "rank")
    for _ in range(2):
        values = stored(_in_wanted(values, sums, ranks, path, bucket), "bucket-rows")
        path = [*path, f"b{len(path)}"]
        bucket = _linear_bucket(F.col("value"), F.col("first"), F.col("last"))
        sums = stored(_bucket_sums(values, path, bucket), "bucket-sums")
    values = _in_wanted(values, sums, ranks, path, bucket)
    path = [*path, f"b{len(path)}"]

    counted = values.groupBy(*path, "start", "value").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*path).orderBy("value"))
    counted = counted.withColumn("start", F.col("start") + upto - F.col("rows"))
    holds = F.col("rank").between(F.col("start"), F.col("start") + F.col("rows") - 1)
    ends = (
        counted.join(F.broadcast(wanted), (counted["column"] == wanted["wanted_column"]) & holds)
        .groupBy("column", "p", "at")
        .agg(F.min("value").alias("a"), F.max("value").alias("b"))
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
    return ends.select("column", "p", value.alias("value"))
