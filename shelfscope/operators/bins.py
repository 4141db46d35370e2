"""Price and discount bands, and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.functions.matching import computed_once


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """Position of the band (edge[i], edge[i+1]] holding the value, NULL outside all bands."""
    ladder = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (value > float(edges[i])) & (value <= float(edges[i + 1]))
        ladder = F.when(inside, i).otherwise(ladder)
    return ladder


def band_counts(
    df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """Rows per band, empty bands included. One counter per band: every task sends one row."""
    band = band_of(F.col(column), edges)
    counted = df.agg(*[F.count_if(band == i).alias(f"n{i}") for i in range(len(labels))])
    cells = [
        F.struct(F.lit(i).alias("band_ord"), F.lit(label).alias("band"), F.col(f"n{i}").alias("n"))
        for i, label in enumerate(labels)
    ]
    return counted.select(F.inline(F.array(*cells)))


def price_bands(
    products: DataFrame,
    edges: Sequence[float] = fv.PRICE_EDGES,
    labels: Sequence[str] = fv.PRICE_LABELS,
) -> DataFrame:
    """Products per price band in band order; zero, negative and missing prices are in none."""
    return band_counts(products, "price", edges, labels)


def discount_bands(
    products: DataFrame,
    edges: Sequence[float] = fv.DISCOUNT_EDGES,
    labels: Sequence[str] = fv.DISCOUNT_LABELS,
) -> DataFrame:
    """Products per discount band, largest first; no discount is in no band."""
    return band_counts(products, "discount_pct", edges, labels).orderBy(F.desc("n"), "band_ord")


def histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """Equal-width histogram: bin (from 1), its bounds, and rows; bins without rows are left out.
    The greatest value belongs to the last bin, and equal values make one bin."""
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    bounds = values.agg(F.struct(F.min("v").alias("least"), F.max("v").alias("greatest"))).scalar()
    ranged = computed_once(values, bounds=bounds).select("v", "bounds.*")
    width = (F.col("greatest") - F.col("least")) / n
    place = F.floor(F.try_divide(F.col("v") - F.col("least"), width)) + 1
    return (
        ranged.withColumn("width", width)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(1)), F.lit(n)).cast("int"))
        .groupBy("bin", "least", "width")
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.col("least") + F.col("width") * (F.col("bin") - 1)).alias("lo"),
            (F.col("least") + F.col("width") * F.col("bin")).alias("hi"),
            "n",
        )
        .orderBy("bin")
    )
