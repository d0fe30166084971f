"""Sources: labelled prompt files, whole text files, chat requests, chunk streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chat import parse_requests

CHUNK_SCHEMA = "stream_id string, seq bigint, ts timestamp, chunk string, eos boolean"


def read_attack_csv(spark: SparkSession, path: str) -> DataFrame:
    """``prompt, expected`` of a labelled prompt file.

    The first row of each file is a header if its first cell is ``prompt`` in any case; a
    missing or empty label means ``blocked``. Quoted cells may span lines. Blank rows are skipped.
    """
    schema = "prompt string, expected string"
    options = {"quote": '"', "escape": '"', "multiLine": True, "enforceSchema": True, "mode": "PERMISSIVE"}
    # places rise within a file, since a file whose cells span lines is read in one piece
    rows = spark.read.schema(schema).options(**options).csv(path).select(
        "prompt", "expected", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    firsts = rows.groupBy("__file").agg(F.min(F.struct("__at", F.lower("prompt").alias("cell"))).alias("f"))
    headers = firsts.filter("f.cell = 'prompt'").select("__file", F.col("f.__at").alias("__at"))
    return rows.join(headers, ["__file", "__at"], "left_anti").filter(F.col("prompt").isNotNull()).select(
        "prompt", F.coalesce(F.nullif("expected", F.lit("")), F.lit("blocked")).alias("expected"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(path, text)`` per file, the whole content as one text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_chat_requests(spark: SparkSession, path: str) -> DataFrame:
    """Chat requests, one JSON object per line, in long form.

    ``conv_id`` is the file and the row's place, so equal requests stay apart.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("request"),
        F.concat_ws("#", "_metadata.file_path", F.monotonically_increasing_id().cast("string")).alias("conv_id"))
    return parse_requests(lines)


def read_documents(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """Retrieved context: any Parquet table with a text column."""
    return spark.read.parquet(path).withColumnRenamed(text_col, "text")


def read_chunk_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files: int | None = None) -> DataFrame:
    """Streaming chunk feed ``(stream_id, seq, ts, chunk, eos)`` from files.

    ``max_files`` bounds a micro-batch, and so what one stream can hold in memory.
    """
    reader = spark.readStream.schema(CHUNK_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def chunk_texts(df: DataFrame, stream_id: str, text_col: str, size: int, ts=None) -> DataFrame:
    """Cut texts into chunks of ``size`` characters, the last one marked ``eos``.

    Works on a streaming frame as well: a narrow projection and an explode.
    """
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    stamp = F.lit("2024-01-01").cast("timestamp") if ts is None else ts
    cut = df.select(F.col(stream_id).cast("string").alias("stream_id"), stamp.alias("ts"), pieces.alias("p"))
    return (cut.select("stream_id", "ts", F.size("p").alias("n"), F.posexplode("p").alias("i", "chunk"))
            .select("stream_id", F.col("i").cast("bigint").alias("seq"), "ts", "chunk",
                    (F.col("i") == F.col("n") - 1).alias("eos")))
