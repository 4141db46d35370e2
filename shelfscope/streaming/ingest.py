"""Incremental product collection: page snapshots in, products not seen before out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators.collection import with_links
from shelfscope.sources.pages import CardRules, extract_product_cards

PAGE_SCHEMA = "page_id bigint, url string, html string"
FOR_GOOD = None


def named(in_dir: str, file_name: str | None) -> str:
    """The path of the files or folders of that name (a glob). The braces make any name a glob, as a stream
    takes a path that is none for a folder."""
    return f"{in_dir}/{{{file_name}}}" if file_name else in_dir


def new_cards(
    pages: DataFrame,
    rules: CardRules = CardRules(),
    host: str | None = None,
    event_time: str = "collected_at",
    horizon: str | None = "30 days",
) -> DataFrame:
    """Streaming pages to unique products by link; any one row of a link is kept.

    Links are remembered for ``horizon`` after the event time (when a page was collected), which
    bounds the state: a link seen again later is new, and pages later than the horizon are lost.
    ``horizon=FOR_GOOD`` remembers every link and needs no event time; its state grows with the
    number of links.
    """
    cards = with_links(extract_product_cards(pages, rules), host)
    if horizon is FOR_GOOD:
        return cards.dropDuplicates(["link"])
    return cards.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["link"])


def ingest_cards_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    rules: CardRules = CardRules(),
    host: str | None = None,
    schema: str = PAGE_SCHEMA,
    max_files_per_trigger: int | None = None,
    event_time: str = "collected_at",
    horizon: str | None = "30 days",
    file_name: str | None = None,
) -> StreamingQuery:
    """Process the page files that arrived since the last run and append new products.

    The checkpoint keeps read files and seen links, so a restart neither repeats nor loses a
    product. Runs through everything available, then stops. ``file_name`` (a glob) picks files of
    ``in_dir``, or folders of files, as a table stored by several tasks is one.
    Pages without the event time column count as collected when their file was written.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.parquet(named(in_dir, file_name))
    if event_time not in pages.columns:
        pages = pages.withColumn(event_time, F.col("_metadata.file_modification_time"))
    cards = new_cards(pages, rules, host, event_time, horizon)
    return (
        cards.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
