"""Pattern redaction as column expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import LOOSE_PII, STRICT_PII, java_regex, linear_lead


@dataclass(frozen=True)
class RedactionRule:
    """Replace every match of ``regex`` by ``<NAME_REDACTED>``.

    ``guard`` names a cheap necessary condition for a match (see ``GUARDS``). Most
    texts hold no personal data, so it spares them the costly pattern and the
    rewrite. Tags hold neither digits nor ``@``, so a guard tested once on the
    original text stays necessary for every later rule.
    """

    name: str
    regex: str
    guard: str | None = None
    # a match of a built-in pattern can never start with '<', so a text that
    # holds one always changes; caller patterns are searched for instead
    changes_text: bool = False

    @property
    def tag(self) -> str:
        return f"<{self.name}_REDACTED>"

    def replace(self, text: Column, guards: Mapping[str, Column] | None = None) -> Column:
        safe_tag = self.tag.replace("\\", r"\\").replace("$", r"\$")
        out = F.regexp_replace(text, F.lit(self.regex), F.lit(safe_tag))
        return guarded(self.guard, text, out, guards)

    def hit(self, before: Column, after: Column) -> Column:
        return before != after if self.changes_text else before.rlike(self.regex)


GUARDS: dict[str, Callable[[Column], Column]] = {
    "at": lambda text: text.contains("@"),
    "digit_run": lambda text: text.rlike(r"\p{Nd}{4}"),
    "digit": lambda text: text.rlike(r"\p{Nd}"),
    "iban_head": lambda text: text.rlike(r"[A-Z]{2}[0-9]{2}"),
}


def guarded(guard: str | None, text: Column, out: Column, guards: Mapping[str, Column] | None) -> Column:
    """``out`` where the guard holds; ``guards`` are tests made earlier."""
    if guard is None:
        return out
    test = (guards or {}).get(guard)
    return F.when(GUARDS[guard](text) if test is None else test, out).otherwise(text)


def guard_columns(rules: Iterable, text: Column) -> dict[str, Column]:
    return {r.guard: GUARDS[r.guard](text) for r in rules if r.guard}


def _built_in(table: Mapping[str, str], names: Iterable[str], card_guard: str) -> list[RedactionRule]:
    guards = {"EMAIL": "at", "PHONE": "digit_run", "SSN": "digit_run", "CREDIT_CARD": card_guard}
    return [RedactionRule(n, linear_lead(java_regex(table[n])), guards[n], changes_text=True)
            for n in names if n in table]


def strict_rules(names: Iterable[str] = tuple(STRICT_PII)) -> list[RedactionRule]:
    """Rules in the caller's order; unknown names are ignored."""
    return _built_in(STRICT_PII, names, "digit_run")


def loose_rules() -> list[RedactionRule]:
    return _built_in(LOOSE_PII, LOOSE_PII, "digit")


def custom_rules(patterns: Mapping[str, str]) -> list[RedactionRule]:
    """Caller-supplied ``{name: pattern}`` in Python regex notation."""
    return [RedactionRule(n, java_regex(p)) for n, p in patterns.items()]


def labels(flags: Iterable[tuple[str, Column]]) -> Column:
    """Array of the labels whose flag is true, in order.

    Plain ``concat`` of one- or zero-element arrays: unlike ``filter`` over an
    array it stays inside whole-stage codegen.
    """
    parts = [F.when(flag, F.array(F.lit(label))).otherwise(no_labels()) for label, flag in flags]
    return F.concat(*parts) if parts else no_labels()


def no_labels() -> Column:
    return F.array().cast("array<string>")


def rewrite_matches(text: Column, regex: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace each match by ``rewrite(match)``; Spark has no callback replace.

    Splits on the matches and zips the gaps with the rewritten matches, so every
    span is judged where it stands. The pattern must not match the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    joined = F.zip_with(
        gaps, hits, lambda gap, hit: F.when(hit.isNull(), gap).otherwise(F.concat(gap, rewrite(hit)))
    )
    return F.when(text.rlike(regex), F.array_join(joined, "")).otherwise(text)
