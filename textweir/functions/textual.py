"""Small scalar helpers: coercion, previews, number text, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(x: Column) -> Column:
    """Two decimals, half to even on the exact binary value, no digit grouping."""
    return F.call_function("format_number", x, F.lit("0.00"))


def coerce_text(raw: Column) -> Column:
    """Text of a JSON message: ``content``, else ``text``, else the raw string."""
    is_object = raw.rlike(r"^\s*\{")
    content = F.nullif(F.get_json_object(raw, "$.content"), F.lit(""))
    text = F.nullif(F.get_json_object(raw, "$.text"), F.lit(""))
    return F.when(is_object, F.coalesce(content, text, raw)).otherwise(raw)


def preview(text: Column, width: int = 50, ellipsis: str = "...") -> Column:
    return F.when(F.length(text) > width,
                  F.concat(F.substring(text, 1, width), F.lit(ellipsis))).otherwise(text)


# --- fixed values: model-name prefix, provider, payload adapter ----------------
PROVIDERS = (
    ("gpt-", "openai", "openai"),
    ("o1-", "openai", "openai"),
    ("claude-", "anthropic", "anthropic"),
    ("gemini-", "gemini", "gemini"),
    ("grok-", "xai", "openai"),
)
FALLBACK_PROVIDER = ("local", "openai")


def route_provider(model: Column) -> Column:
    """``struct(provider, adapter)`` by model-name prefix."""
    low = F.lower(model)

    def pick(index: int) -> Column:
        chain = F
        for prefix, *target in PROVIDERS:
            chain = chain.when(low.startswith(prefix), F.lit(target[index]))
        return chain.otherwise(F.lit(FALLBACK_PROVIDER[index]))

    return F.struct(pick(0).alias("provider"), pick(1).alias("adapter"))


def request_verdict(action: Column, reason: Column, status: Column) -> Column:
    """Verdict text of one gateway request."""
    blocked = F.concat(F.lit("BLOCKED: "), F.coalesce(F.nullif(reason, F.lit("")), F.lit("Unknown")))
    return (F.when(action == "blocked", blocked)
            .when(status == 200, F.lit("PASSED"))
            .otherwise(F.concat(F.lit("FAILED_"), status.cast("string"))))


def log_display(original: Column, sanitized: Column, verdict: Column, latency_s: Column) -> list[Column]:
    """Columns of the log view: redaction mark, card class, milliseconds."""
    card = (F.when(verdict == "PASSED", F.lit("passed"))
            .when(verdict.contains("BLOCKED"), F.lit("blocked")).otherwise(F.lit("failed")))
    return [(original != sanitized).alias("is_redacted"), card.alias("card_class"),
            F.round(latency_s * 1000, 0).cast("long").alias("latency_ms")]
