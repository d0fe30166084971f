"""A training corpus from raw documents: toxic ones out, near-copies and contaminated ones out,
personal data pseudonymised, the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.decontaminate import overlaps
from textweir.llm.neardup import near_duplicates
from textweir.llm.packing import pack
from textweir.llm.pii import pseudonymize
from textweir.llm.shared import drop_saved, fresh_path, saved, small
from textweir.llm.toxicity import toxic_documents

TOKENIZER = "word_bpe_49k.json"
#: Percent of common shingles from which the near-duplicate stage links documents.
ALIKE = 85
#: A user passes a secret one.
KEY = "textweir"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, stored with a key of its own for each row, so that rows that share a doc_id, or have none, are
    judged and kept each for itself; and the key's name."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is not in ``gone``."""
    gone = saved(gone, "gone")
    out = keyed.join(small(gone), key, "left_anti").drop(key)
    out._reads = [keyed, gone]
    return out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, each row judged by its own text.

    A null or empty text has no sign of toxicity and stays. Rows that repeat a doc_id, or have none, count each.
    """
    names = [c if c == "text" else f"doc_column_{i}" for i, c in enumerate(docs.columns)]  # not those of the verdicts
    verdicts = toxic_documents(docs.toDF(*names), spark.read.parquet(f"{sf_dir}/labels.parquet"), docs, names)
    return verdicts.filter("not rejected").select(*names).toDF(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the row with the smallest doc_id (a null one last, of equal ones any one).

    Rows are grouped by their texts alone, so rows that share a doc_id stay if their texts differ. Texts
    without words are no copies of each other and stay.
    """
    keyed, key = _keyed(docs)
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), ALIKE).select(
        F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)
    ranked = saved(found.join(keyed.select(key, "doc_id"), key).select("group", key, rank.alias("rank")), "groups")
    # both stored: Spark can split the join at a group of very many rows
    best = saved(ranked.groupBy("group").agg(F.min("rank").alias("best"), F.count("*").alias("n")).filter("n > 1"), "best")
    gone = ranked.join(best, "group").filter(F.col(key) != F.col(f"best.{key}")).select(key)
    out = _without(keyed, key, gone)
    drop_saved(ranked)
    drop_saved(best)
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in passages of the benchmark, each row judged by
    its own text. A null or empty text has no words and stays."""
    keyed, key = _keyed(docs)
    found = overlaps(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, key, found.filter("contaminated").select(F.col("doc_id").alias(key)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their personal data replaced; ``n_chars`` follows the text, and is null for a null one."""
    made = pseudonymize(docs, KEY).drop("kinds")
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences, with the token ids. A null text packs as an empty one;
    rows that repeat a doc_id, or have none, are packed each."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination),
    ("pii", pii), ("packing", packing),
]

#: The first stage is a trained model and the last a tokenizer's ids: the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        for table in getattr(made, "_reads", ()):
            drop_saved(table)
        docs = spark.read.parquet(path)
    return docs
