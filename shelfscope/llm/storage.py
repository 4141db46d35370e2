"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`; where that is unset (tests), beside the warehouse.

    The path is a URI of a file system that all executors reach. Nothing is created here.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    )
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once: written as Parquet in the shared folder and read again.

    Cuts the lineage, so that a lost executor costs the tasks that read its part, not the jobs
    before. The written row order within files is kept; the number of rows may be zero.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def conf_int(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores until no column of `df` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
