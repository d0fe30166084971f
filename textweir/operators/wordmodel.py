"""A scoring model in closed form: smoothed log-odds of words, fitted and applied as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, materialize


def _words(text: Column) -> Column:
    """The distinct lower-cased words of a text, runs of ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def fit_word_odds(rows: DataFrame, label: str, text_col: str = "text", least: int = 3) -> tuple[DataFrame, float]:
    """``(word, weight)`` and the bias, from rows with a 0/1 ``label``; rows with a NULL label or text are not used.

    The weight of a word is the log of its share of the marked rows over that of the others, each count
    one higher; the bias is the log of the number of marked rows over the others. Words that
    fewer than ``least`` rows have are left out.
    """
    rows = rows.select(F.col(label).cast("int").alias("y"), F.col(text_col).alias("t")).dropna()
    ones, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    words = rows.select("y", F.explode(_words(F.col("t"))).alias("word")).groupBy("word").agg(
        F.sum("y").alias("ones"), F.count("*").alias("n")).filter(F.col("n") >= least)
    weight = F.log((F.col("ones") + 1) / F.lit(ones + 2.0)) - F.log((F.col("n") - F.col("ones") + 1) / F.lit(n - ones + 2.0))
    bias = F.log(F.lit((ones + 1.0) / (n - ones + 1.0)))
    spark = rows.sparkSession
    return materialize(words.select("word", weight.alias("weight")), "odds"), spark.range(1).select(bias).first()[0]


def score_words(df: DataFrame, key: str, odds: DataFrame, bias: float, text_col: str = "text") -> DataFrame:
    """``(key, score)``: the probability of the mark, from the mean weight of a text's known words times eight, and the bias.

    ``key`` identifies a text. A text without known words has the bias alone, a NULL text a NULL score.
    """
    words = df.select(key, F.explode(_words(F.col(text_col))).alias("word"))
    known = words.join(checked_broadcast(odds), "word").groupBy(key).agg((F.avg("weight") * 8.0).alias("w"))
    z = F.coalesce("w", F.lit(0.0)) + F.lit(bias)
    score = F.when(F.col(text_col).isNotNull(), 1.0 / (1.0 + F.exp(-z)))
    return df.select(key, text_col).join(known, key, "left").select(key, score.alias("score"))
