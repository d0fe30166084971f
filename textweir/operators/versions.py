"""Policies that change in time: versions as a table, each request judged by the version of its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import guard_columns, labels, strict_rules
from ..functions.rules import INJECTION_LABEL
from ..functions.verdict import verdict_columns
from ..policy import Policy
from ..session import checked_broadcast, materialize
from .blocklist import blocklist_hits
from .scan import Stage, State, run_stages, seal


def as_of(rows: DataFrame, versions: DataFrame, time_col: str, by: Sequence[str] = ("policy",), valid_from: str = "valid_from",
          order: str = "version") -> DataFrame:
    """``rows`` with the other columns of the version of ``versions`` that held at ``time_col``, NULL before the first.

    A version holds from ``valid_from`` (inclusive) until the next one of the same ``by``; of versions that
    begin together the one with the largest ``order`` holds. Versions that are few (counted by their days) are
    broadcast, so the rows stay where they are; else both sides meet by ``by`` and day. Rows without a
    time have no version.
    """
    day = F.to_date(time_col)
    low, high = rows.agg(F.min(day), F.max(day)).first()
    rest = [c for c in versions.columns if c not in by]
    until = F.lead(valid_from).over(Window.partitionBy(*by).orderBy(valid_from, order))
    spans = versions.filter(F.col(valid_from).isNotNull()).withColumn("__until", until).filter(
        F.col("__until").isNull() | (F.col("__until") > F.col(valid_from)))
    first = F.greatest(F.to_date(valid_from), F.lit(low).cast("date"))
    last = F.least(F.coalesce(F.to_date("__until"), F.lit(high).cast("date")), F.lit(high).cast("date"))
    spans = spans.select(*by, F.struct(*rest).alias("__v"), "__until", first.alias("__first"), last.alias("__last")).filter(
        "__first <= __last").select(*by, "__v", "__until", F.explode(F.sequence("__first", "__last")).alias("__day"))
    # a few days of all rows are a few keys: versions that are few go to the rows instead
    spans = checked_broadcast(spans.toDF(*(f"__by{i}" for i in range(len(by))), "__v", "__until", "__day"))
    here = F.col("__given") == F.col("__day")
    for i, c in enumerate(by):
        here &= F.col(c) == F.col(f"__by{i}")
    time = F.col(time_col)
    held = here & (time >= F.col(f"__v.{valid_from}")) & (F.col("__until").isNull() | (time < F.col("__until")))
    joined = rows.withColumn("__given", day).join(spans, held, "left")
    return joined.select(*rows.columns, *(F.col(f"__v.{c}").alias(c) for c in rest if c not in rows.columns))


def policy_rows(policy: Policy, name: str, version: int) -> list[tuple[str, int, str, str, int]]:
    """The rules of a policy as rows (policy, version, kind, value, rank)."""
    listed = {"pii": policy.pii_patterns if policy.pii_enabled else (), "topic": policy.topics,
              "keyword": policy.effective_keywords if policy.injection_enabled else ()}
    return [(name, version, kind, value, i) for kind, values in listed.items() for i, value in enumerate(values)]


RULES = "policy string, version int, kind string, value string, rank int"


def versioned_scan(requests: DataFrame, versions: DataFrame, rules: DataFrame, key: str, time_col: str = "time",
                   text_col: str = "text") -> DataFrame:
    """``requests`` (``key``, policy, time, text) with the verdict of their policy as it was at their time.

    Adds version, sanitized_text, triggered, valid, reason, action. ``versions`` has policy, version,
    valid_from, shadow_mode; ``rules`` the rows of ``policy_rows``: personal data to redact, topics and injection
    keywords (whole words), of any number. A request before the first version, or of an unknown
    policy, has a NULL version and no rules. ``key`` identifies a request; the requests are stored once.
    """
    keep = requests.columns
    at = ["policy", "version"]
    held = as_of(requests, versions.select(*at, "valid_from", "shadow_mode"), time_col)
    kinds = rules.filter("kind = 'pii'").groupBy(*at).agg(F.collect_set("value").alias("__pii"))  # names of the built-in patterns
    held = held.join(checked_broadcast(kinds), at, "left")
    built_in = strict_rules()

    def guards(state: State) -> State:
        return {f"guard_{k}": c for k, c in guard_columns(built_in, state["text"]).items()}

    def redact(rule) -> Stage:
        def run(state: State) -> State:
            wanted = F.coalesce(F.array_contains(state["pii"], rule.name), F.lit(False))
            after = rule.replace(state["text"], {k[6:]: c & wanted for k, c in state.items() if k.startswith("guard_")})
            return {"text": after, f"hit_{rule.name}": rule.hit(state["text"], after)}
        return run

    out, state = run_stages(held, {"text": F.col(text_col), "pii": F.col("__pii")}, [guards, *map(redact, built_in)])
    pii = labels((f"PII:{r.name}", F.coalesce(state[f"hit_{r.name}"], F.lit(False))) for r in built_in)
    stored = materialize(out.select(*keep, "version", "shadow_mode", state["text"].alias("sanitized_text"), pii.alias("__pii_labels")),
                         "versioned")

    def hits(kind: str) -> DataFrame:
        terms = rules.filter(F.col("kind") == kind).select(*at, F.col("value").alias("term"), "rank")
        found = blocklist_hits(stored.filter("version is not null"), key, terms, "sanitized_text", by=at)
        return found.select(F.col(key).alias(f"__{kind}_key"), F.col("label").alias(f"__{kind}"))

    def listed(label: Column) -> Column:
        return F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>"))

    for kind in ("keyword", "topic"):
        stored = stored.join(hits(kind), F.col(key) == F.col(f"__{kind}_key"), "left").drop(f"__{kind}_key")
    injection = F.when(F.col("__keyword").isNotNull(), F.lit(INJECTION_LABEL))
    blocking = F.concat(listed(injection), listed(F.col("__topic")))
    judged = stored.withColumn("__rules", blocking).withColumn("triggered", F.concat("__pii_labels", "__rules"))
    verdict = verdict_columns(F.col("triggered"), F.size("__rules") > 0, F.coalesce("shadow_mode", F.lit(False)))
    return seal(judged, [*keep, "version"], {"sanitized_text": F.col("sanitized_text"), "triggered": F.col("triggered"), **verdict})
