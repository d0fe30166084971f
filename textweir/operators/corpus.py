"""Corpus operators: sanitizing documents, sentence-wise sanitizing, many policies at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import sentence_body, sentence_pieces, sentence_separator
from ..functions.textual import route_provider
from ..policy import Policy
from ..session import materialize
from .scan import (Models, as_source, detector_stages, lower_stage, needs_rows, redaction_key,
                   redaction_stages, result_columns, run_parallel, scan, scan_array, seal, verdict_stage)

POLICIES_PER_PASS = 8


def sanitize_corpus(df: DataFrame, policy: Policy, text_col: str = "text", redact_only: bool = False,
                    models: Models = Models()) -> DataFrame:
    """Valid texts are kept, sanitized; blocked ones are dropped or replaced by a notice."""
    columns = df.columns
    checked = scan(df, policy, text_col, models=models)
    text = F.col("sanitized_text")
    if redact_only:
        text = F.when(F.col("valid"), text).otherwise(
            F.concat(F.lit("[CONTENT REDACTED: "), F.col("reason"), F.lit("]")))
    else:
        checked = checked.filter("valid")
    return checked.withColumn(text_col, text).select(*columns)


def split_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per sentence: ``pos, sentence, separator`` replace the text."""
    keep = [c for c in df.columns if c != text_col]
    pieces = df.select(*keep, F.posexplode(sentence_pieces(F.col(text_col))).alias("pos", "__piece"))
    return pieces.select(*keep, "pos", sentence_body(F.col("__piece")).alias("sentence"),
                         sentence_separator(F.col("__piece")).alias("separator"))


def emit_text(valid, text, reason):
    """What a stream shows for one sentence."""
    return F.when(valid, text).otherwise(F.concat(F.lit("[BLOCKED: "), reason, F.lit("]")))


def sanitize_sentence_rows(df: DataFrame, policy: Policy, text_col: str = "text",
                           models: Models = Models()) -> DataFrame:
    """``split_sentences`` with each sentence validated as output, plus ``emitted``."""
    rows = scan(split_sentences(df, text_col), policy, "sentence", "output", models)
    shown = emit_text(F.col("valid"), F.col("sanitized_text"), F.col("reason"))
    return rows.withColumn("emitted", F.concat(shown, F.col("separator")))


def sanitize_by_sentence(df: DataFrame, policy: Policy, text_col: str = "text",
                         models: Models = Models()) -> DataFrame:
    """Texts with every sentence validated on its own: ``sanitized_text, n_blocked``.

    The sentences of a text stay an array in its row, so re-assembly needs no shuffle. Only a
    policy with a model has them as rows, which a shuffle brings together again; the texts are stored
    before, so that a row keeps its number when an executor is lost.
    """
    keep = df.columns
    if needs_rows(policy, models):
        return _by_sentence_rows(df, policy, text_col, models)
    cut = df.withColumn("__pieces", sentence_pieces(F.col(text_col)))
    cut = cut.withColumns({
        "__body": F.transform("__pieces", sentence_body),
        "__sep": F.transform("__pieces", sentence_separator)})
    done = scan_array(cut, "__body", policy, "__v", models)
    shown = F.zip_with("__v", "__sep", lambda v, sep: F.concat(
        emit_text(v["valid"], v["text"], v["reason"]), sep))
    return seal(done, keep, {"sanitized_text": F.array_join(shown, ""),
                             "n_blocked": F.size(F.filter("__v", lambda v: ~v["valid"]))})


def _by_sentence_rows(df: DataFrame, policy: Policy, text_col: str, models: Models) -> DataFrame:
    keep = df.columns
    named = materialize(df.select(F.struct(*keep).alias("__row"), F.col(text_col).alias("__text"),
                                  F.monotonically_increasing_id().alias("__id")), "sentences")
    rows = named.select("__id", "__row", F.posexplode_outer(sentence_pieces(F.col("__text"))).alias("__pos", "__piece"))
    rows = rows.select(  # the row goes along with its first sentence only
        "__id", "__pos", F.when(F.coalesce("__pos", F.lit(0)) == 0, F.col("__row")).alias("__row"),
        sentence_body(F.col("__piece")).alias("__body"), sentence_separator(F.col("__piece")).alias("__sep"))
    done = scan(rows, policy, "__body", "output", models)
    shown = F.concat(emit_text(F.col("valid"), F.col("sanitized_text"), F.col("reason")), F.col("__sep"))
    whole = done.groupBy("__id").agg(
        F.first("__row", ignorenulls=True).alias("__row"),
        F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", shown.alias("t"))))).alias("__s"),
        F.count_if(~F.col("valid")).cast("int").alias("n_blocked"))
    text = F.when(F.col(f"__row.`{text_col}`").isNotNull(), F.array_join(F.transform("__s", lambda s: s["t"]), ""))
    return whole.select("__row.*", text.alias("sanitized_text"), "n_blocked")


def multi_policy_scan(df: DataFrame, policies: Sequence[Policy], text_col: str = "text",
                      source: str | Column = "input", models: Models = Models()) -> DataFrame:
    """Every text under every policy: one row per text and policy.

    One read serves ``POLICIES_PER_PASS`` policies, since the generated code grows
    with them. Policies that redact alike share the redacted text.
    """
    keep = df.columns
    out = None
    for start in range(0, len(policies), POLICIES_PER_PASS):
        group = policies[start : start + POLICIES_PER_PASS]
        alike = {redaction_key(p): p for p in group}
        steps = [({"text": F.col(text_col)}, [*redaction_stages(p, models), lower_stage]) for p in alike.values()]
        cur, states = run_parallel(df, steps)
        redacted = dict(zip(alike, states))
        cur, states = run_parallel(cur, [
            (redacted[redaction_key(p)], [*detector_stages(p, as_source(source), models), verdict_stage(p)])
            for p in group])
        verdicts = [F.struct(F.lit(p.name).alias("policy"), *[c.alias(n) for n, c in result_columns(s).items()])
                    for p, s in zip(group, states)]
        rows = cur.select(*keep, F.inline(F.array(*verdicts)))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no policies given")
    return out


def route_traffic(df: DataFrame, model_col: str = "model") -> DataFrame:
    """``df`` plus ``provider`` and ``adapter``."""
    return df.withColumn("__p", route_provider(F.col(model_col))).select(
        *df.columns, F.col("__p.provider").alias("provider"), F.col("__p.adapter").alias("adapter"))
