"""Audit rows and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textual import two_decimals
from ..policy import Policy


def audit_events(scanned: DataFrame, policy: Policy, source: str | Column = "input",
                 text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Library audit events of scanned texts. One row has no latency of its own in a
    distributed scan, so ``latency_ms`` stays NULL unless the input brings one."""
    latency = F.col("latency_ms") if "latency_ms" in scanned.columns else F.lit(None)
    src = F.lit(source) if isinstance(source, str) else source
    return scanned.select(
        *keys, F.current_timestamp().alias("timestamp"), F.lit(policy.name).alias("profile"),
        src.alias("source"), "valid", "action", "reason", latency.cast("double").alias("latency_ms"),
        F.lit(policy.shadow_mode).alias("shadow_mode"), F.length(text_col).alias("input_len"))


def console_line(event: str = "") -> Column:
    """``[Audit] ALLOWED|BLOCKED[ (SHADOW)] | Rule: … | Latency: …ms``."""
    col = (lambda n: F.col(f"{event}.{n}")) if event else F.col
    return F.concat(
        F.lit("[Audit] "), F.when(col("valid"), F.lit("ALLOWED")).otherwise(F.lit("BLOCKED")),
        F.when(col("shadow_mode"), F.lit(" (SHADOW)")).otherwise(F.lit("")),
        F.lit(" | Rule: "), F.coalesce(col("reason"), F.lit("")),
        F.lit(" | Latency: "), F.coalesce(two_decimals(col("latency_ms")), F.lit("n/a")), F.lit("ms"))


def gateway_rows(scanned: DataFrame, client_col: str, verdict: Column, latency: Column,
                 metadata: Column | None = None, text_col: str = "text", keep_original: bool = False) -> DataFrame:
    """Gateway audit rows. The unredacted text is kept only on request, else its hash."""
    original = F.col(text_col) if keep_original else F.sha2(F.col(text_col), 256)
    meta = F.lit("{}") if metadata is None else F.coalesce(F.to_json(metadata), F.lit("{}"))
    return scanned.select(
        F.current_timestamp().alias("timestamp"), F.col(client_col).cast("string").alias("client_ip"),
        original.alias("original_prompt"), F.col("sanitized_text").alias("sanitized_prompt"),
        verdict.alias("verdict"), latency.cast("double").alias("latency"), meta.alias("metadata"))


def audit_counts(events: DataFrame) -> DataFrame:
    """Counts and mean latency for every combination of profile, source and action,
    with sub-totals (NULL = all); partial aggregates, so frequent values are cheap."""
    return (events.cube("profile", "source", "action")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"),
                 F.grouping_id().alias("level")))


#: Of the sketches of latencies: their size, and the error in rank of a percentile from them, merged or not.
SKETCH_K, RANK_ERROR = 200, 0.03


def latency_sketches(events: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """One quantile sketch of the latencies for each cell of profile, source and action, and each value of ``by``.

    Sketches are a few KB whatever the number of events, and those of several batches can be
    merged, so percentiles over any span of batches need no events. Events without a latency
    count in ``n`` only.
    """
    return events.groupBy(*by, "profile", "source", "action").agg(
        F.count("*").alias("n"), F.count("latency_ms").alias("n_latency"),
        F.kll_sketch_agg_double("latency_ms", SKETCH_K).alias("sketch"))


def latency_percentiles(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles for every combination of profile, source and action, with sub-totals (NULL = all), from the
    merged sketches: ``n`` and an array ``latency_ms``, right within ``RANK_ERROR`` of the rank; NULL without a latency."""
    merged = (sketches.cube("profile", "source", "action").agg(
        F.sum("n").alias("n"), F.sum("n_latency").alias("__known"), F.grouping_id().alias("level"),
        F.kll_merge_agg_double(F.when(F.col("n_latency") > 0, F.col("sketch"))).alias("__sketch")))
    found = F.kll_sketch_get_quantile_double("__sketch", F.array(*map(F.lit, shares)))
    return merged.select("profile", "source", "action", "level", "n", F.when(F.col("__known") > 0, found).alias("latency_ms"))


def rule_frequency(scanned: DataFrame) -> DataFrame:
    """How often each label fired, with its detector."""
    return (scanned.select(F.explode("triggered").alias("label")).groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("detector", F.substring_index("label", ":", 1)))


def _arrival(rows: DataFrame) -> list[str]:
    """The columns that order audit rows: ids start again in every batch of an audit table."""
    return [c for c in ("batch_id", "id") if c in rows.columns]


def audit_latest(rows: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` rows by batch and id (a top-k, not a full sort)."""
    return rows.orderBy(*[F.desc(c) for c in _arrival(rows)]).limit(n)


def new_audit_rows(rows: DataFrame, mark: tuple[int, ...] | None) -> DataFrame:
    """Rows past a mark of ``high_water_mark`` (None: all), with ``notice``: passed, but the text was changed."""
    changed = F.col("original_prompt") != F.col("sanitized_prompt")
    if mark is not None:
        place = F.struct(*[F.col(c).cast("bigint").alias(c) for c in _arrival(rows)])
        reached = F.struct(*[F.lit(int(v)).cast("bigint").alias(c) for c, v in zip(_arrival(rows), mark, strict=True)])
        rows = rows.filter(place > reached)
    return rows.withColumn("notice", changed & (F.col("verdict") == "PASSED"))


def high_water_mark(rows: DataFrame) -> tuple[int, ...] | None:
    """The place of the newest row, one number for each of batch and id; None for an empty table."""
    last = rows.agg(F.max(F.struct(*_arrival(rows)))).first()[0]
    return None if last is None else tuple(last)


def effective_rules(listed: DataFrame, defaults: list[str], policy_col: str, rule_col: str) -> DataFrame:
    """Each policy's own rules united with the default ones, distinct (long form)."""
    own = listed.select(policy_col, rule_col).distinct()
    added = own.select(policy_col).distinct().select(
        policy_col, F.explode(F.array(*[F.lit(d) for d in defaults])).alias(rule_col))
    return own.union(added).distinct()
