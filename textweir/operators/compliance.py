"""Scoring of labelled prompt sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textual import preview
from ..policy import Policy
from .scan import Models, scan


def compliance_status(http_code: Column, error_code: Column) -> Column:
    """``blocked`` for a policy refusal, ``passed`` for a 200, else ``error``."""
    refused = (http_code == 400) & F.coalesce(error_code.contains("security_policy_violation"), F.lit(False))
    return (F.when(refused, F.lit("blocked")).when(http_code == 200, F.lit("passed"))
            .otherwise(F.lit("error")))


def run_corpus(corpus: DataFrame, policy: Policy, prompt_col: str = "prompt",
               models: Models = Models(), upstream: Column | None = None) -> DataFrame:
    """Validate a labelled corpus: adds ``http_code, error_code, status, action, met``.

    ``upstream`` is the status that a prompt gets that is not refused (200 by default); any other than 200
    is an ``error``. A blank row (NULL prompt) is not sent: it has no status, and counts in the total only.
    """
    keep = corpus.columns
    out = scan(corpus, policy, prompt_col, models=models)
    sent, refused = F.col(prompt_col).isNotNull(), F.col("action") == "blocked"
    out = out.withColumns({
        "http_code": F.when(sent, F.when(refused, F.lit(400)).otherwise(F.lit(200) if upstream is None else upstream.cast("int"))),
        "error_code": F.when(sent & refused, F.lit("security_policy_violation")),
        "action": F.when(sent, F.col("action"))})
    out = out.withColumn("status", F.when(sent, compliance_status(F.col("http_code"), F.col("error_code"))))
    extra = ["http_code", "error_code", "status", "action", "reason"]
    if "expected" in keep:
        out = out.withColumn("met", expectation_met(F.col("expected"), F.col("action")) & (F.col("status") != "error"))
        extra.append("met")
    return out.select(*keep, *extra)


def expectation_met(expected: Column, action: Column) -> Column:
    return (F.when(expected == "redacted_or_blocked", action.isin("redacted", "blocked"))
            .when(expected.isin("passed", "allowed"), action != "blocked")
            .otherwise(action == "blocked"))


def compliance_summary(details: DataFrame) -> DataFrame:
    """One row; the rate is the share of blocked prompts among all rows, blank ones included, as a percentage."""
    count = lambda s: F.count_if(F.col("status") == s)
    return details.agg(
        F.count(F.lit(1)).alias("total"), count("blocked").alias("blocked"),
        count("passed").alias("passed"), count("error").alias("errors"),
    ).withColumn("compliance_rate", F.when(
        F.col("total") > 0, F.col("blocked") / F.col("total") * 100).otherwise(F.lit(0.0)))


def compliance_confusion(details: DataFrame) -> DataFrame:
    """Expected against actual action, with the share that met the expectation; blank rows are left out."""
    return details.filter("status is not null").groupBy("expected", F.col("action").alias("actual")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("met").alias("n_met"))


def report_details(details: DataFrame, prompt_col: str = "prompt", keys: tuple[str, ...] = ()) -> DataFrame:
    """Detail rows of the report, with the first 200 characters of the raw answer; blank rows have none."""
    raw = F.to_json(F.struct("http_code", "error_code", "reason"))
    return details.filter("status is not null").select(*keys, F.col(prompt_col).alias("prompt"), "status", F.lit(None).cast("double").alias("latency_ms"),
                          "http_code", F.substring(raw, 1, 200).alias("raw_response"),
                          preview(F.col(prompt_col)).alias("prompt_preview"))
