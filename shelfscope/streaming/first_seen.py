"""The first card of every link in page order, over a stream of pages, with a snapshot after each step.

Each link has a keyed state: the least row so far (by an order of columns, page and position by default)
and whether it is settled. A step (one trigger) brings, per link, the row where it is new or where a smaller
one came (`new`, `better`). A timer at the first row's event time settles the link once the watermark has
passed, i.e. once no earlier page may still come (`settled`); after `horizon` more, a second timer forgets
it. Rows of a settled link change nothing.

Steps are written as folders `step=N` by trigger number, each replaced as a whole, so a step that is run
again after a failure leaves no second copy. The snapshot after step N is, per link, the least row of the
steps up to N: the same as de-duplicating all pages read so far, in whatever order their files came.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfscope.operators.collection import with_links
from shelfscope.sources.pages import CardRules, extract_product_cards
from shelfscope.streaming.ingest import named

# The processor travels to the executors by value, as page parsers do.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ("page_id", "pos")
NEW, BETTER, SETTLED = "new", "better", "settled"


class FirstRow(StatefulProcessor):
    """Holds the least row of a link; `columns` are its values, `at` the place of the event time in them."""

    def __init__(self, columns: list[str], schema: T.StructType, order: list[int], at: int, horizon_ms: int | None):
        self.columns, self.schema, self.order, self.at, self.horizon_ms = columns, schema, order, at, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.settled = handle.getValueState("settled", "settled boolean")

    def frame(self, change: str, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([[change, *row]], columns=["change", *self.columns], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        place = lambda row: tuple(row[i] for i in self.order)
        for frame in rows:
            for row in frame[self.columns].astype(object).itertuples(index=False, name=None):
                if least is None or place(row) < place(least):
                    least = row
        if least is None or self.settled.exists():
            return
        least = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in least)
        before = self.held.get() if self.held.exists() else None
        if before is None:
            self.held.update(least)
            self.handle.registerTimer(int(least[self.at].timestamp() * 1000))
            yield self.frame(NEW, least)
        elif place(least) < place(before):
            self.held.update(least)
            yield self.frame(BETTER, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.settled.exists():
            self.settled.clear()
            self.held.clear()
            return
        row = self.held.get()
        self.settled.update((True,))
        if self.horizon_ms is not None:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.horizon_ms)
        yield self.frame(SETTLED, row)

    def close(self) -> None:
        pass


def first_cards(
    cards: DataFrame, order: Sequence[str] = ORDER, event_time: str = "collected_at", delay: str = "1 day",
    horizon_days: float | None = 30,
) -> DataFrame:
    """Streaming cards (with `link` and `event_time`) to changes of the first card per link (column `change`).

    ``delay`` is how much later than a page an earlier one may still come; ``horizon_days`` how long a settled
    link is remembered (None: for good).
    """
    columns = list(cards.columns)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in cards.schema.fields])
    out = T.StructType([T.StructField("change", T.StringType()), *schema.fields])
    processor = FirstRow(
        columns, schema, [columns.index(c) for c in order], columns.index(event_time),
        None if horizon_days is None else int(horizon_days * 86_400_000),
    )
    return cards.withWatermark(event_time, delay).groupBy("link").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime"
    )


def ingest_first_cards(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    rules: CardRules = CardRules(),
    host: str | None = None,
    schema: str = "page_id bigint, url string, html string",
    files_per_step: int = 1,
    bytes_per_step: int | None = None,
    file_name: str | None = None,
    order: Sequence[str] = ORDER,
    event_time: str = "collected_at",
    delay: str = "1 day",
    horizon_days: float | None = 30,
    quiet_steps: int | None = None,
    at_least: int = 4,
) -> StreamingQuery:
    """Read the page files that arrived since the last run, a step per ``files_per_step``, then stop.

    With ``bytes_per_step`` a step takes files up to that size together, one at least, so the
    number of steps does not follow the number of files. ``file_name`` (a glob) picks files of ``in_dir``, or
    folders of files, as a table stored by several tasks is one.
    Changes of each step go to ``out_dir/step=N`` (`snapshot` reads them). With ``quiet_steps``, the run also
    stops once that many steps after the first ``at_least`` brought no new link; the files left are read
    by the next run. Needs the RocksDB state store (`session.build_session`). Pages without the event time
    column count as collected when their file was written.
    """
    reader = spark.readStream.schema(schema)
    if bytes_per_step is None:
        reader = reader.option("maxFilesPerTrigger", files_per_step)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_step)
    pages = reader.parquet(named(in_dir, file_name))
    if event_time not in pages.columns:
        pages = pages.withColumn(event_time, F.col("_metadata.file_modification_time"))
    cards = with_links(extract_product_cards(pages, rules), host)
    changes = first_cards(cards, order, event_time, delay, horizon_days)
    enough, quiet = threading.Event(), [0]

    def save(step: DataFrame, number: int) -> None:
        folder = f"{out_dir}/step={number}"
        step.write.mode("overwrite").parquet(folder)
        fresh = not spark.read.schema(step.schema).parquet(folder).filter(F.col("change") == NEW).isEmpty()
        quiet[0] = 0 if fresh or number < at_least else quiet[0] + 1
        if quiet_steps is not None and quiet[0] >= quiet_steps:
            enough.set()

    query = (
        changes.writeStream.foreachBatch(save).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if quiet_steps is not None:
        while not query.awaitTermination(1):
            if enough.is_set():
                query.stop()
    return query


def snapshot(spark: SparkSession, out_dir: str, step: int | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """The first card of each link as known after ``step`` (the last one by default)."""
    rows = spark.read.parquet(out_dir)
    if step is not None:
        rows = rows.filter(F.col("step") <= step)
    columns = [c for c in rows.columns if c not in ("change", "step")]
    least = rows.groupBy("link").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return least.select("row.*")


def settled(spark: SparkSession, out_dir: str) -> DataFrame:
    """Cards that no later page can change."""
    return spark.read.parquet(out_dir).filter(F.col("change") == SETTLED).drop("change", "step")
