"""Stand-alone guards: ``Column -> struct(valid, sanitized_text, reason, action, redacted_types)``.

Also the extension surface: any ``Callable[[Column], Column]`` that returns this
struct is a guard, and any that returns a nullable message is a plugin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import first_substring, has_keyword, joined_matches, joined_substrings
from .redaction import rewrite_matches
from .rules import PROFANITY_WORDS, STANDALONE_INJECTION_KEYWORDS, TOXIC_WORDS, keyword_regex
from .textual import two_decimals
from .verdict import guard_result

Guard = Callable[[Column], Column]
Plugin = Callable[[Column], Column]

_ALLOWED = "allowed"


def _block_or_pass(text: Column, message: Column, prefix: str, passed: str, suffix: str = "") -> Column:
    hit = message.isNotNull()
    reason = F.when(hit, F.concat(F.lit(prefix), message, F.lit(suffix))).otherwise(F.lit(passed))
    return guard_result(~hit, text, reason,
                        F.when(hit, F.lit("blocked")).otherwise(F.lit(_ALLOWED)))


def injection_guard(text: Column, keywords: Iterable[str] = ()) -> Column:
    words = tuple(keywords) or STANDALONE_INJECTION_KEYWORDS
    return _block_or_pass(text, first_substring(text, words),
                          "Prompt Injection Detected: '", "Passed Injection Check", "'")


def topic_guard(text: Column, block_list: Iterable[str] = ()) -> Column:
    words = tuple(block_list)
    if not words:
        return guard_result(F.lit(True), text, F.lit("No topics configured"), F.lit(_ALLOWED))
    return _block_or_pass(text, joined_matches(text, words, ", "),
                          "Restricted topic detected: ", "Passed topic check")


def profanity_guard(text: Column, words: Iterable[str] = PROFANITY_WORDS, mode: str = "block") -> Column:
    """``block`` lists the matches (sorted); ``redact`` masks each with ``*`` per character."""
    if mode == "block":
        return _block_or_pass(text, joined_matches(text, words, ", "),
                              "Profanity detected: ", "Clean content")
    if mode == "redact":
        masked = rewrite_matches(text, keyword_regex(words),
                                 lambda hit: F.repeat(F.lit("*"), F.length(hit)))
        hit = F.coalesce(has_keyword(text, words), F.lit(False))
        return guard_result(F.lit(True), masked,
                            F.when(hit, F.lit("Profanity redacted")).otherwise(F.lit("Clean content")),
                            F.when(hit, F.lit("redacted")).otherwise(F.lit(_ALLOWED)))
    raise ValueError(f"unknown profanity mode {mode!r}")


def competitor_message(text: Column, competitors: Iterable[str], low: Column | None = None) -> Column:
    found = joined_substrings(text, [c.lower() for c in competitors], low=low)
    return F.concat(F.lit("Competitor mentions detected: "), found)


def toxic_message(text: Column, words: Iterable[str] = TOXIC_WORDS, low: Column | None = None) -> Column:
    return F.concat(F.lit("Toxic language detected: "), joined_substrings(text, words, low=low))


def external_message(text: Column, competitors: Iterable[str] = (), toxicity: bool = False,
                     low: Column | None = None) -> Column:
    """First failing external check, competitor mentions before toxic words."""
    names = tuple(competitors)
    checks = [competitor_message(text, names, low)] if names else []
    checks += [toxic_message(text, low=low)] if toxicity else []
    if not checks:
        return F.lit(None).cast("string")
    return F.concat(F.lit("External: Guardrails Validation Failed: "), F.coalesce(*checks))


def score_message(score: Column, threshold: float = 0.5) -> Column:
    """Toxicity message when the model score is strictly over the threshold."""
    return F.when(score > F.lit(float(threshold)),
                  F.concat(F.lit("LangKit: Toxicity detected ("), two_decimals(score), F.lit(")")))


def substitution_guard(text: Column, blocked_marker: str, replacements: Mapping[str, str]) -> Column:
    """Template of a custom guard: block on a literal marker, else replace literals."""
    out = text
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    hit = F.coalesce(text.contains(blocked_marker), F.lit(False))
    return guard_result(~hit, F.when(hit, text).otherwise(out),
                        F.when(hit, F.lit("Marker found"))
                        .otherwise(F.lit("No marker found")),
                        F.when(hit, F.lit("blocked")).otherwise(F.lit(_ALLOWED)))


_PLUGINS: dict[str, Plugin] = {}


def register_plugin(name: str, plugin: Plugin) -> None:
    _PLUGINS[name] = plugin


def get_plugin(name: str) -> Plugin:
    return _PLUGINS[name]
