"""Readers and schema canonicalisation for products, reviews and scored reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.functions.values import blank_to_null, clean_double, coerce_numeric
from shelfscope.lexicon import NEGATIVE, POSITIVE, Lexicon
from shelfscope.operators.sentiment import score_sentiment, unpack_reasons

NUMERIC = {
    "products": ["price", "list_price", "discount_pct"],
    "reviews": ["helpful_count"],
    "sentiment": ["positive_score", "negative_score"],
}
INTEGER = {"products": [], "reviews": ["page_number"], "sentiment": []}
COLUMNS = {
    "products": fv.PRODUCT_COLUMNS,
    "reviews": fv.REVIEW_COLUMNS,
    "sentiment": fv.SENTIMENT_COLUMNS,
}


def read_csv_text(
    spark: SparkSession, path: str | Sequence[str], line_breaks: bool = True
) -> DataFrame:
    """CSV with header, every column text, blank as NULL; quoted line breaks and doubled quotes
    are understood and a byte order mark is skipped.

    Files that may hold quoted line breaks cannot be split: each is one task. ``line_breaks=False``
    is for files known to hold none, which are read in splits. Large tables belong in Parquet.
    """
    return spark.read.csv(
        path if isinstance(path, str) else list(path),
        header=True,
        multiLine=line_breaks,
        quote='"',
        escape='"',
        encoding="UTF-8",
        nullValue="",
        emptyValue="",
        inferSchema=False,
    )


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt evenly over `partitions` tasks; None leaves them as read.

    A file that cannot be split (CSV with line breaks, Parquet of one row group) is read by one task, and
    whatever is done with its texts up to the next shuffle too. Where a table is few such files and the work
    on a row costs more than moving it, deal the rows out once. Tables of many splits need nothing.
    """
    return df if partitions is None else df.repartition(partitions)


def _read(spark: SparkSession, path: str, line_breaks: bool = True, partitions: int | None = None) -> DataFrame:
    """Parquet where the path says so, else CSV."""
    name = path.rstrip("/").lower()
    df = spark.read.parquet(path) if name.endswith("parquet") else read_csv_text(spark, path, line_breaks)
    return dealt(df, partitions)


def _first_readable(
    spark: SparkSession, paths: Sequence[str], line_breaks: bool, partitions: int | None
) -> DataFrame:
    for path in paths:
        try:
            return _read(spark, path, line_breaks, partitions)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these can be read: {', '.join(paths)}")


def canonicalize(df: DataFrame, kind: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename headers, add missing optional columns as NULL and type the numeric columns, so that
    "column absent" and "all missing" are the same thing downstream.

    When several headers map to one name the first filled one counts. Products get ``style_text``:
    the name where there is a name column, else the text column.
    """
    mapping = {**fv.PRODUCT_HEADERS, **(mapping or {})} if kind == "products" else dict(mapping or {})
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        sources.setdefault(mapping.get(column, column), []).append(column)
    has_name = "name" in sources

    columns = []
    for name in [*COLUMNS[kind], *(c for c in sources if c not in COLUMNS[kind])]:
        found = [F.col(f"`{c}`") for c in sources.get(name, [])]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        dtype = dict(df.dtypes)[sources[name][0]] if found else "string"
        if name in NUMERIC[kind]:
            value = coerce_numeric(value) if dtype == "string" else clean_double(value)
        elif name in INTEGER[kind]:
            value = coerce_numeric(value).cast("int") if dtype == "string" else value.cast("int")
        elif not found or (name in COLUMNS[kind] and dtype == "string" and name != "text"):
            value = blank_to_null(value)
        columns.append(value.alias(name))
    out = df.select(*columns)
    if kind == "products" and "style_text" not in out.columns:
        out = out.withColumn("style_text", F.col("name") if has_name else F.col("text"))
    if kind == "sentiment":
        for column in ("positive_reasons", "negative_reasons"):
            if dict(out.dtypes)[column] == "string":
                out = out.withColumn(column, unpack_reasons(F.col(column)))
        out = out.withColumn("positive_score", F.col("positive_score").cast("int"))
        out = out.withColumn("negative_score", F.col("negative_score").cast("int"))
    return out


def read_products(
    spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None, line_breaks: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Products; ``line_breaks`` as in `read_csv_text`, ``partitions`` as in `dealt`."""
    return canonicalize(_read(spark, path, line_breaks, partitions), "products", mapping)


def read_reviews(
    spark: SparkSession, paths: str | Sequence[str], line_breaks: bool = True, partitions: int | None = None
) -> DataFrame:
    """Reviews from the first path that exists (enhanced before basic); ``line_breaks`` as in
    `read_csv_text`, ``partitions`` as in `dealt`."""
    paths = [paths] if isinstance(paths, str) else paths
    return canonicalize(_first_readable(spark, paths, line_breaks, partitions), "reviews")


def read_sentiment(
    spark: SparkSession,
    path: str,
    reviews: DataFrame,
    positive: Lexicon = POSITIVE,
    negative: Lexicon = NEGATIVE,
    line_breaks: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Saved scored reviews, or the reviews scored now when nothing is saved at the path. A saved
    blank or missing reason list means no reasons."""
    try:
        return canonicalize(_read(spark, path, line_breaks, partitions), "sentiment")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return score_sentiment(reviews, positive, negative)


def union_catalogues(*catalogues: DataFrame) -> DataFrame:
    """All rows of several result tables; columns missing in one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogues)
