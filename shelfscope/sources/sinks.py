"""CSV output with a byte order mark, output names and export row layouts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv

BOM = "﻿"


def pack_reasons(reasons: Column) -> Column:
    """Reason structs as ``category:keyword, category:keyword``."""
    return F.array_join(
        F.transform(reasons, lambda r: F.concat(r["category"], F.lit(":"), r["keyword"])), ", "
    )


def write_csv_bom(df: DataFrame, path: str, mode: str = "error", single_file: bool = False) -> None:
    """CSV with header, doubled quotes and a UTF-8 byte order mark in every file.

    Reason arrays are packed to text. The output stays partitioned; ``single_file`` is meant for
    small report tables.
    """
    for name, dtype in df.dtypes:
        if dtype.startswith("array<struct<"):
            df = df.withColumn(name, pack_reasons(F.col(name)))
    first = df.columns[0]
    out = df.withColumnRenamed(first, BOM + first)
    if single_file:
        out = out.coalesce(1)
    out.write.csv(
        path, header=True, quote='"', escape='"', encoding="UTF-8", emptyValue="", mode=mode
    )


def dated_path(base: str, name: str, day: date | datetime, with_time: bool = False) -> str:
    """``base/name_yyyymmdd.csv``; spaces in the name (a search term) become underscores."""
    stamp = day.strftime("%Y%m%d_%H%M%S" if with_time else "%Y%m%d")
    return f"{base.rstrip('/')}/{name.replace(' ', '_')}_{stamp}.csv"


def insight_rows(strengths: DataFrame, kind: str = fv.STRENGTH_TYPE) -> DataFrame:
    """Strengths with messages as export rows."""
    return strengths.select(
        F.lit(kind).alias("type"), "category", "keyword", "frequency", "percentage", "message"
    )


def improvement_rows(topics: DataFrame) -> DataFrame:
    return topics.select("category", "count", "percentage")
