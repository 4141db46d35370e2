"""Session helpers: defaults for a new session, and tables in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "shelfscope", **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; cluster settings come from spark-submit.

    State of the ingest stream grows with the number of distinct links, so it is kept in RocksDB
    rather than on the executor heap.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(STATE_STORE, ROCKSDB)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session says."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names, else beside the warehouse tables."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    )
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows computed once: written as Parquet to the shared folder and read again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
