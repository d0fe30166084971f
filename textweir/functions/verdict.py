"""Packaging of triggered labels into a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PII_REASON = "PII Redacted"


def verdict_columns(labels: Column, blocking: Column, shadow: Column) -> dict[str, Column]:
    """``valid, reason, action`` of a label array whose blocking state is known."""
    any_label = F.size(labels) > 0
    return {
        "valid": ~blocking | shadow,
        "reason": F.when(blocking, F.array_join(labels, ", "))
        .when(any_label, F.lit(PII_REASON)).otherwise(F.lit("")),
        "action": F.when(blocking & shadow, F.lit("shadow_block"))
        .when(blocking, F.lit("blocked"))
        .when(any_label, F.lit("redacted")).otherwise(F.lit("allowed")),
    }


def package_verdict(labels: Column, shadow: Column | bool = False) -> Column:
    """Verdict struct of any label array: only labels outside ``PII:`` block."""
    shadow = F.lit(shadow) if isinstance(shadow, bool) else shadow
    blocking = ~F.forall(labels, lambda label: label.startswith("PII:"))
    cols = verdict_columns(labels, blocking, shadow)
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def guard_result(valid: Column, text: Column, reason: Column, action: Column,
                 redacted_types: Column | None = None) -> Column:
    """The common result struct of a stand-alone guard."""
    types = F.array().cast("array<string>") if redacted_types is None else redacted_types
    return F.struct(valid.alias("valid"), text.alias("sanitized_text"), reason.alias("reason"),
                    action.alias("action"), types.alias("redacted_types"))
