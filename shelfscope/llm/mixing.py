"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Their prefix
sums within the source, shifted by one random offset, cross an integer boundary as often as the document
is taken. Documents stand in the order of their size, so what a source yields stays close to its target,
whatever its largest document.

The prefix sum is a rank times the expected copies. Ranks come from counts of small cells (source, class
of sizes, hash), so no source, however large, is sorted or summed in one task.

Defined results: null source is a source of its own, last in order; null or empty text has size 0 and is
taken by its boundaries like any other, adding no words; a source without words has target 0; rows equal
in every column are interchangeable; no rows -> no rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.llm.sharding import hashable, uniform
from shelfscope.llm.storage import stored

WORD_GAP = r"[\x20\x09-\x0D]+"
CLASSES_PER_DOUBLING = 16


def n_words(text: Column) -> Column:
    """Number of runs of characters outside 0x20 and 0x09-0x0D; null: 0."""
    return (F.size(F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), WORD_GAP)) - 2).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most_copies: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order, null last. All targets together are the sum of
    all sizes; none exceeds `most_copies` times its source. What is above goes to the others by weight
    until nothing is, which is the level at which the sum of min(limit, level x weight) is the total:
    found in one pass over the sources in the order of limit / weight.
    """
    ordered = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most_copies)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    levels = limited.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole)
    return levels.select(
        "source", "source_size",
        F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: float = 3.0, seed: int = 29) -> DataFrame:
    """`docs` with size, source_size, target and copies (how often the mix takes the row)."""
    docs = docs.drop("size", "source_size", "target", "copies")
    names = [F.col(f"`{c}`") for c in hashable(docs)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("src"),
        n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *names).alias("h"),
    )
    small = stored(rows.select("src", "size", "h"), "mix-sizes")
    found = small.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size"))
    aims = stored(targets(found, weights, most_copies), "mix-targets")
    buckets = max(1, math.isqrt(small.count()) // 16)

    def celled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES_PER_DOUBLING)).withColumn(
            "bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))
        )

    before = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = stored(
        celled(small).groupBy(F.col("src").alias("source"), "class", "bucket").agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .alias("c").join(aims.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("c.source").alias("source"), "class", "bucket", "base", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
            uniform(F.lit(seed), F.lit("offset"), F.coalesce(F.hex("c.source"), F.lit("null"))).alias("offset"),
        ),
        "mix-cells",
    )
    within = W.partitionBy("src", "class", "bucket").orderBy("size", "h")
    rank = F.col("base") + F.col("n") - 1
    crossed = F.floor(F.col("rate") * (rank + 1) + F.col("offset")) - F.floor(F.col("rate") * rank + F.col("offset"))
    numbered = celled(rows).withColumn("n", F.row_number().over(within)).alias("r")
    same = F.col("r.src").eqNullSafe(F.col("c.source")) & (F.col("r.class") == F.col("c.class")) & (F.col("r.bucket") == F.col("c.bucket"))
    return numbered.join(cells.alias("c"), same).select(
        *[F.col(f"r.row.`{c}`") for c in docs.columns], F.col("r.size").alias("size"),
        "source_size", "target", crossed.cast("long").alias("copies"),
    )


def taken(mixed: DataFrame) -> DataFrame:
    """One row per copy of what `mix` takes, with the columns of its input."""
    columns = [F.col(f"`{c}`") for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
