"""Uniform shuffle into shards of exact size (DataFrame functions only).

Rows are dealt into blocks by a hash. How many rows of a block go to a shard is drawn from the exact
law of a uniform shuffle: the matrix of counts, blocks x shards, has multivariate hypergeometric rows
within fixed margins (block sizes, and shard sizes that differ by one at most). Each block is permuted
and cut by its counts, rows move to their shards, and each shard is permuted again.

Both permutations sort small cells, never a whole shard: a block has about sqrt(rows) rows, and so has a
cell of a shard, whose slots follow from counts of the cells before it. Everything is decided by hashes
of the rows and the seed, so a repeated task gives the same rows.

The counts are drawn by SQL expressions on two tables of block counts (groups of blocks, then blocks
within each group), by the ratio-of-uniforms rejection method for the hypergeometric law.

Defined results: nulls anywhere, empty and long texts are ordinary values; rows equal in every column
are interchangeable and stay in one block; no rows -> no rows. Columns named like the added ones are
replaced (upper and lower case do not differ).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.storage import stored

TRIES = 100
#: The hat of the ratio-of-uniforms method, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
HAT_WIDTH = 1.7155277699214135
HAT_SHIFT = 0.8989161620588988


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, taken back by the product in between."""

    def at(z: Column) -> Column:
        product = (z - 8.0) * (z - 7.0) * (z - 6.0) * (z - 5.0) * (z - 4.0) * (z - 3.0) * (z - 2.0) * (z - 1.0)
        series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
        return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)

    return let(n.cast("double") + 9.0, at)


def hypergeometric(total: Column, good: Column, sample: Column, *seed: Column) -> Column:
    """How many of `good` marked ones a uniform sample of `sample` out of `total` holds."""

    def draw(p: Column) -> Column:
        fewer, more, m, total = p["fewer"], p["more"], p["m"], p["total"]
        share = fewer / total

        def with_centre(c: Column) -> Column:
            def weight(z: Column) -> Column:
                return log_factorial(z) + log_factorial(fewer - z) + log_factorial(m - z) + log_factorial(more - m + z)

            def attempts(peak: Column) -> Column:
                def attempt(found: Column, k: Column) -> Column:
                    x, y = uniform(*seed, k, F.lit(0)), uniform(*seed, k, F.lit(1))
                    tried = let(
                        F.struct(x.alias("x"), (c["mean"] + (HAT_WIDTH * c["width"] + HAT_SHIFT) * (y - 0.5) / x).alias("at")),
                        lambda t: F.when((t["at"] < 0) | (t["at"] >= c["most"]), F.lit(-1.0)).otherwise(
                            let(
                                F.floor(t["at"]).cast("double"),
                                lambda z: F.when(2.0 * F.ln(t["x"]) <= peak - weight(z), z).otherwise(F.lit(-1.0)),
                            )
                        ),
                    )
                    return F.when(found >= 0, found).otherwise(tried)

                drawn = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1.0), attempt)
                return let(drawn, lambda z: F.when(z >= 0, z).otherwise(c["mode"]))

            return let(weight(c["mode"]), attempts)

        width = F.sqrt((total - m) * m * share * (1.0 - share) / (total - 1.0) + 0.5)
        mean = m * share + 0.5
        centre = F.struct(
            mean.alias("mean"), width.alias("width"),
            F.floor((m + 1.0) * (fewer + 1.0) / (total + 2.0)).cast("double").alias("mode"),
            F.least(F.least(m, fewer) + 1.0, F.floor(mean + 16.0 * width).cast("double")).alias("most"),
        )
        z = let(centre, with_centre)
        return let(z, lambda z: let(
            F.when(p["good"] > p["bad"], m - z).otherwise(z),
            lambda z: F.when(m < p["sample"], p["good"] - z).otherwise(z),
        ))

    parameters = F.struct(
        total.cast("double").alias("total"), good.cast("double").alias("good"), (total - good).cast("double").alias("bad"),
        sample.cast("double").alias("sample"), F.least(good, total - good).cast("double").alias("fewer"),
        F.greatest(good, total - good).cast("double").alias("more"), F.least(sample, total - sample).cast("double").alias("m"),
    )
    return (
        F.when((good <= 0) | (sample <= 0), F.lit(0).cast("long"))
        .when(good >= total, sample)
        .when(sample >= total, good)
        .otherwise(let(parameters, draw).cast("long"))
    )


def row_of_counts(room: Column, rows: Column, *seed: Column) -> Column:
    """`rows` dealt over shards with `room` left: a multivariate hypergeometric draw, shard by shard."""

    def one(state: Column, shard: Column) -> Column:
        drawn = hypergeometric(state["left"], shard["room"], state["rows"], *seed, shard["n"])
        return let(drawn, lambda x: F.struct(
            (state["left"] - shard["room"]).alias("left"), (state["rows"] - x).alias("rows"),
            F.concat(state["counts"], F.array(x)).alias("counts"),
        ))

    shards = F.transform(room, lambda x, n: F.struct(x.alias("room"), n.alias("n")))
    none = F.array().cast("array<long>")
    left = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.aggregate(shards, F.struct(left.alias("left"), rows.alias("rows"), none.alias("counts")), one, lambda s: s["counts"])


def matrix(room: Column, blocks: Column, *seed: Column) -> Column:
    """array<struct<block, rows, counts>>: the blocks' rows dealt over `room`, block after block."""

    def one(state: Column, block: Column) -> Column:
        return let(row_of_counts(state["room"], block["rows"], *seed, block["block"]), lambda counts: F.struct(
            F.transform(F.arrays_zip(state["room"].alias("a"), counts.alias("b")), lambda x: x["a"] - x["b"]).alias("room"),
            F.concat(state["out"], F.array(F.struct(
                block["block"].alias("block"), block["rows"].alias("rows"), counts.alias("counts"),
            ))).alias("out"),
        ))

    none = F.array().cast("array<struct<block:long,rows:long,counts:array<long>>>")
    return F.aggregate(blocks, F.struct(room.alias("room"), none.alias("out")), one, lambda s: s["out"])


def communication_matrix(blocks: DataFrame, sizes: list[int], groups: int, seed: int) -> DataFrame:
    """(block, counts) for `blocks` (block, rows) and shards of `sizes`: margins are met exactly."""
    room = F.lit(sizes).cast("array<long>")
    dealt = lambda key: F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("block"), "rows")))
    grouped = blocks.withColumn("part", F.pmod("block", F.lit(groups)))
    by_group = (
        grouped.groupBy("part").agg(F.sum("rows").alias("rows"), dealt("block").alias("blocks"))
    )
    first = (
        grouped.groupBy("part").agg(F.sum("rows").alias("rows"))
        .groupBy().agg(dealt("part").alias("parts"))
        .select(F.explode(matrix(room, F.col("parts"), F.lit(seed), F.lit("groups"))).alias("m"))
        .select(F.col("m.block").alias("part"), F.col("m.counts").alias("room"))
    )
    return (
        by_group.join(first, "part")
        .select(F.explode(matrix(F.col("room"), F.col("blocks"), F.lit(seed), F.lit("blocks"))).alias("m"))
        .select("m.block", "m.counts")
    )


def even_sizes(rows: int, shards: int) -> list[int]:
    """Exact shard sizes, at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def hashable(df: DataFrame) -> list[str]:
    """Columns that tell rows apart: all but maps, which Spark does not hash."""
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """`docs` with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard), uniformly shuffled."""
    docs = docs.drop("shard", "slot")
    names = [F.col(f"`{c}`") for c in hashable(docs)]
    shape = T.StructType(docs.schema.fields)
    total = docs.count()
    root = max(1, math.isqrt(total))
    cells = max(1, math.isqrt(total) // shards)
    own = lambda *what: F.xxhash64(F.lit(seed), *what)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own(*names).alias("h"))
    rows = rows.withColumn("block", F.pmod(own(F.lit("block"), "h"), F.lit(root)))
    counts = stored(
        communication_matrix(rows.groupBy("block").agg(F.count("*").alias("rows")), even_sizes(total, shards), max(1, math.isqrt(root)), seed),
        "shard-matrix",
    )

    place = F.row_number().over(W.partitionBy("block").orderBy(own(F.lit("first"), "h"), "h")) - 1
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda k: F.aggregate(F.slice("counts", 1, k), F.lit(0).cast("long"), lambda a, x: a + x),
    )

    def moved(rows: DataFrame) -> DataFrame:
        """Rows permuted within their block and cut by its counts."""
        cut = counts.select("block", ends.alias("ends"))
        return (
            rows.withColumn("place", place)
            .join(cut, "block")
            .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
            .withColumn("cell", F.pmod(own(F.lit("cell"), "h"), F.lit(cells)))
            .drop("block", "place", "ends")
        )

    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(
        moved(rows.drop("row")).groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
        "shard-bases",
    )
    again = W.partitionBy("shard", "cell").orderBy(own(F.lit("second"), "h"), "h")
    return (
        moved(rows)
        .withColumn("n", F.row_number().over(again))
        .join(bases, ["shard", "cell"])
        .select(*[F.col(f"row.`{f.name}`") for f in shape.fields], "shard", (F.col("base") + F.col("n") - 1).alias("slot"))
    )
