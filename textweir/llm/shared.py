"""Helpers of the operators in this folder: cut points, checked broadcasts, safe column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows of a few numbers each (about 10 MB); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="textweir-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read back by column.

    Cuts the lineage: what reads it survives the loss of executors without a new scan of the
    texts. The files live as long as the caller keeps the folder; ``drop_saved`` removes them.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(df: DataFrame | None) -> None:
    """Remove a table made by ``saved`` that nothing reads any more."""
    path = getattr(df, "_saved_at", None)
    if path is not None:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def training_sample(docs: DataFrame, rows: int, chars: int) -> DataFrame:
    """One row of ``docs`` (doc_id, text, and any other columns) for each of at most ``rows`` documents with at most
    ``chars`` characters in all.

    Documents come in the order of the hash of their doc_id until either bound is reached; of rows that share
    a doc_id the one with the smallest hash of its text stands for it. Rows without a doc_id are not taken.
    """
    hashed = docs.filter("doc_id is not null").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    facts = hashed.groupBy("doc_id").agg(F.min("text_hash").alias("h"), F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))
    chosen, left = [], chars
    for r in facts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
        left -= r["n"]
        if left < 0:
            break
        chosen.append((r["doc_id"], r["h"]))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, text_hash bigint")  # bounded by ``rows``
    return hashed.join(F.broadcast(picked), ["doc_id", "text_hash"]).dropDuplicates(["doc_id"]).select(*docs.columns)


def fold_case(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def attach(docs: DataFrame, made: DataFrame, key: str, names: list[str], how: str = "left") -> DataFrame:
    """``docs`` with the columns ``names`` of ``made`` by ``key``; own columns of these names are replaced."""
    return docs.drop(*names).join(made.select(key, *names), key, how)
