"""SQL statements of the rules, for checking results with a second engine.

RE2 has ASCII word boundaries and no look-around. Keyword rules therefore work on
a text whose non-word characters are doubled: each match may then consume one
of them on either side.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from ..functions.rules import INJECTION_LABEL, LOOSE_PII, STRICT_PII, TOXIC_WORDS
from ..policy import Policy

NONWORD = r"[^\pL\pN_]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def padded(text: str) -> str:
    return rf"regexp_replace({text}, '({NONWORD})', '\1\1', 'g')"


def _alternation(words: Sequence[str]) -> str:
    doubled = [re.sub(r"(\W)", r"\1\1", w) for w in dict.fromkeys(words)]
    return "|".join(re.escape(w) for w in doubled)


def keyword_pattern(words: Sequence[str]) -> str:
    return quote(f"(?i)(?:^|{NONWORD})({_alternation(words)})(?:$|{NONWORD})")


def has_keyword(text: str, words: Sequence[str]) -> str:
    return f"regexp_matches({padded(text)}, {keyword_pattern(words)})"


def sorted_matches(text: str, words: Sequence[str]) -> str:
    """Distinct matches, sorted (single-word keywords)."""
    return f"list_sort(list_distinct(regexp_extract_all({padded(text)}, {keyword_pattern(words)}, 1)))"


def joined_matches(text: str, words: Sequence[str], sep: str) -> str:
    return f"nullif(array_to_string({sorted_matches(text, words)}, {quote(sep)}), '')"


def joined_substrings(text: str, words: Sequence[str], sep: str = ", ") -> str:
    tests = ", ".join(f"CASE WHEN contains(lower({text}), {quote(w)}) THEN {quote(w)} END" for w in words)
    return f"nullif(concat_ws({quote(sep)}, {tests}), '')"


def first_substring(text: str, words: Sequence[str]) -> str:
    whens = " ".join(f"WHEN contains(lower({text}), {quote(w)}) THEN {quote(w)}" for w in words)
    return f"CASE {whens} END"


def external(text: str, competitors: Sequence[str], toxicity: bool) -> str:
    parts = []
    if competitors:
        found = joined_substrings(text, [c.lower() for c in competitors])
        parts.append(f"'Competitor mentions detected: ' || {found}")
    if toxicity:
        parts.append(f"'Toxic language detected: ' || {joined_substrings(text, TOXIC_WORDS)}")
    return f"'External: Guardrails Validation Failed: ' || coalesce({', '.join(parts)})"


def redact_ctes(source: str, text: str, rules: Mapping[str, str], name: str = "red") -> str:
    """CTEs ``<name>0…n``: the redaction steps, with ``t`` and flags ``h0…``."""
    steps = [f"{name}0 AS (SELECT *, {text} AS t FROM {source})"]
    for i, (label, pattern) in enumerate(rules.items()):
        steps.append(
            f"{name}{i + 1} AS (SELECT * REPLACE (regexp_replace(t, {quote(pattern)}, "
            f"'<{label}_REDACTED>', 'g') AS t), regexp_matches(t, {quote(pattern)}) AS h{i} FROM {name}{i})")
    return ",\n".join(steps)


def label_list(rules: Mapping[str, str], prefix: str, sep: str) -> str:
    tests = ", ".join(f"CASE WHEN h{i} THEN '{prefix}{n}' END" for i, n in enumerate(rules)) or "NULL"
    return f"concat_ws({quote(sep)}, {tests})"


def strict(names: Sequence[str]) -> dict[str, str]:
    return {n: STRICT_PII[n] for n in names if n in STRICT_PII}


LOOSE = dict(LOOSE_PII)


def scan_ctes(source: str, policy: Policy, text: str = "text", is_input: str = "true",
              secrets: Mapping[str, str] | None = None, extra: Sequence[str] = (), name: str = "s") -> str:
    """CTEs of a whole scan; the last, ``<name>``, adds ``sanitized_text, triggered
    (joined by |), valid, reason, action`` to the columns of ``source``.

    ``extra`` are further label expressions over ``t`` (plugins, semantic).
    """
    rules = strict(policy.pii_patterns) if policy.pii_enabled else {}
    red = f"{name}_r"
    ctes = [redact_ctes(source, text, rules, red)]
    last = f"{red}{len(rules)}"
    secret_labels = []
    for j, (kind, pattern) in enumerate((secrets or {}).items()):
        nxt = f"{name}_x{j}"
        ctes.append(f"{nxt} AS (SELECT * REPLACE (regexp_replace(t, {quote(pattern)}, '<SECRET_REDACTED>', 'g') "
                    f"AS t), regexp_matches(t, {quote(pattern)}) AS x{j} FROM {last})")
        secret_labels.append(f"CASE WHEN x{j} THEN 'Secret:{kind}' END")
        last = nxt
    labels = list(secret_labels)
    if policy.injection_enabled:
        labels.append(f"CASE WHEN {is_input} AND {has_keyword('t', policy.effective_keywords)} "
                      f"THEN {quote(INJECTION_LABEL)} END")
    if policy.topics:
        labels.append(f"'Topic:' || {joined_matches('t', policy.topics, ',')}")
    if policy.external_enabled:
        labels.append(f"CASE WHEN {is_input} THEN {external('t', policy.competitors, policy.toxicity_check)} END")
    labels += extra
    pii = label_list(rules, "PII:", "|")
    rule = f"concat_ws('|', {', '.join(labels)})" if labels else "''"
    pii_r = label_list(rules, "PII:", ", ")
    rule_r = f"concat_ws(', ', {', '.join(labels)})" if labels else "''"
    shadow = "true" if policy.shadow_mode else "false"
    ctes.append(f"{name}_l AS (SELECT *, {pii} AS pii_, {rule} AS rule_, {pii_r} AS pii_r, {rule_r} AS rule_r FROM {last})")
    hidden = ["t", "pii_", "rule_", "pii_r", "rule_r", *[f"h{i}" for i in range(len(rules))],
              *[f"x{j}" for j in range(len(secrets or {}))]]
    ctes.append(f"""{name} AS (SELECT * EXCLUDE ({', '.join(hidden)}), t AS sanitized_text,
  concat_ws('|', nullif(pii_, ''), nullif(rule_, '')) AS triggered,
  (rule_ = '' OR {shadow}) AS valid,
  CASE WHEN rule_ <> '' THEN concat_ws(', ', nullif(pii_r, ''), rule_r)
       WHEN pii_ <> '' THEN 'PII Redacted' ELSE '' END AS reason,
  CASE WHEN rule_ <> '' AND {shadow} THEN 'shadow_block' WHEN rule_ <> '' THEN 'blocked'
       WHEN pii_ <> '' THEN 'redacted' ELSE 'allowed' END AS action
  FROM {name}_l)""")
    return ",\n".join(ctes)


PIECE = r"(?s)(?:.*?[.?!](?:\s+|\z)|.+\z)"


def sentence_rows(source: str, text: str, keep: str, name: str = "sent") -> str:
    """CTEs ``<name>``: one row per sentence with ``pos, sentence, separator``."""
    return f"""{name}_p AS (SELECT {keep}, regexp_extract_all({text}, {quote(PIECE)}) AS pieces FROM {source}),
{name}_q AS (SELECT {keep}, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM {name}_p),
{name} AS (SELECT {keep}, pos,
  CASE WHEN regexp_matches(piece, {quote('(?s)[.?!]' + chr(92) + 's+' + chr(92) + 'z')})
       THEN regexp_replace(piece, {quote('(?s)' + chr(92) + 's+' + chr(92) + 'z')}, '') ELSE piece END AS sentence,
  piece FROM {name}_q),
{name}_s AS (SELECT {keep}, pos, sentence, substr(piece, length(sentence) + 1) AS separator FROM {name})"""
