"""Input tables of the registered queries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import shared_folder, work_path
from ..streaming.ordered import ROCKSDB


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream; its schema comes from the batch reader."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern the path may be one file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def write_out(df: DataFrame, label: str, **options: str) -> str:
    """Write a table to the shared folder; returns its path."""
    path = work_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the queries that start inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def finish(writer: DataStreamWriter, spark: SparkSession, label: str, checkpoint: str | None = None) -> None:
    """Run a stream over what its source holds now, to the end."""
    shared_folder(spark)
    checkpoint = checkpoint or work_path(spark, label + "-state")
    with settings(spark, ROCKSDB):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end into Parquet files and read them back."""
    spark = df.sparkSession
    path = work_path(spark, label)
    finish(df.writeStream.format("parquet").option("path", path), spark, label)
    return spark.read.schema(df.schema).parquet(path)
