"""Rule constants and the regular-expression dialect helpers.

Rules are written in Python's regex notation and translated for the JVM.
Python's ``\\b \\d \\s \\w`` follow Unicode on ``str``; Java's follow ASCII unless
told otherwise and differ between JDKs, so the translation spells the character
classes out and does not depend on JVM flags.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# --- fixed values: detector patterns, labels and word lists --------------------

STRICT_PII = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}

LOOSE_PII = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(\+\d{1,2}\s?)?1?\-?\.?\s?(\(?\d{3}\)?[\s.-]?)?\d{3}[\s.-]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
}

INJECTION_KEYWORDS = (
    "ignore previous instructions",
    "ignore all instructions",
    "system override",
    "dan mode",
    "do anything now",
    "unfiltered",
    "jailbreak",
    "developer mode",
    "system prompt",
    "original instructions",
)
# the stand-alone injection guard and the older gateway use the first seven
STANDALONE_INJECTION_KEYWORDS = INJECTION_KEYWORDS[:7]

BASE_INTENTS = (
    "ignore previous instructions",
    "jailbreak attempt",
    "bypassing safety guardrails",
    "revealing system prompt",
    "acting as an unfiltered AI",
    "performing restricted actions",
)

PROFANITY_WORDS = ("badword", "offensive", "toxic", "violence")
TOXIC_WORDS = ("stupid", "ugly", "idiot", "dumb")

ENTITY_TYPES = (
    "EMAIL_ADDRESS",
    "PHONE_NUMBER",
    "US_SSN",
    "CREDIT_CARD",
    "IBAN_CODE",
    "PERSON",
    "LOCATION",
)

INJECTION_LABEL = "Injection:System Prompt Override"
SENTENCE_END = r"(.*?[.?!])(\s+|$)"

# --- dialect helpers -----------------------------------------------------------

# Inner text of Java character classes that hold Python's str semantics.
_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"

NOT_AFTER_WORD = f"(?<![{_WORD}])"
NOT_BEFORE_WORD = f"(?![{_WORD}])"
_EDGE = f"(?:(?<=[{_WORD}]){NOT_BEFORE_WORD}|{NOT_AFTER_WORD}(?=[{_WORD}]))"
_NO_EDGE = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|{NOT_AFTER_WORD}{NOT_BEFORE_WORD})"
_CLASSES = {
    "d": f"[{_DIGIT}]", "D": f"[^{_DIGIT}]",
    "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]",
    "w": f"[{_WORD}]", "W": f"[^{_WORD}]",
}


def java_regex(pattern: str) -> str:
    """Translate a Python ``str`` pattern to Java with the same Unicode meaning."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            i += 2
            if nxt == "b" and not in_class:
                # beside a digit the general boundary is a plain look-around
                if re.match(r"(\(\?:)?\\d", pattern[i:]):
                    out.append(NOT_AFTER_WORD)
                elif re.search(r"\\d(\{\d+\})?$", pattern[: i - 2]):
                    out.append(NOT_BEFORE_WORD)
                else:
                    out.append(_EDGE)
            elif nxt == "B" and not in_class:
                out.append(_NO_EDGE)
            elif nxt in _CLASSES:
                # Java allows a class nested in a class, meaning union
                out.append(_CLASSES[nxt])
            elif nxt == "Z":
                out.append(r"\z")
            else:
                out.append("\\" + nxt)
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' (after an optional '^') is a literal in Python
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif in_class and ch in "[&":
            out.append("\\" + ch)  # nested class / intersection syntax in Java only
        else:
            if ch == "]":
                in_class = False
            out.append(ch)
        i += 1
    return "".join(out)


def linear_lead(regex: str) -> str:
    """Keep a leading character run, such as ``[a-z]+`` in ``[a-z]+@…``, linear.

    If what follows the run is not in its class, the leftmost match starts where the
    run starts, or where the last match ended inside it. Tried anywhere else, a
    long run (an encoded blob, say) would be read again from each of its positions.
    """
    lead = re.match(r"(\[[^\]]+\])\+(?=@)", regex)
    if lead is None or "@" in lead[1]:
        return regex
    return f"(?:\\G|(?<!{lead[1]})){lead[1]}++{regex[lead.end():]}"


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def unique(words: Iterable[str]) -> list[str]:
    """First occurrences, in order."""
    return list(dict.fromkeys(words))


def keyword_regex(keywords: Iterable[str]) -> str:
    """Case-insensitive whole-word alternation, in list order, group 1 = the match.

    A word boundary beside a word character is a plain negative look-around;
    beside punctuation it demands a word character on the other side.
    """
    words = unique(keywords)
    if not words:
        raise ValueError("a keyword rule needs at least one keyword")
    parts = []
    plain = all(w and _is_word(w[0]) and _is_word(w[-1]) for w in words)
    if plain:
        body = "|".join(re.escape(w) for w in words)
        return f"(?iu){NOT_AFTER_WORD}({body}){NOT_BEFORE_WORD}"
    for w in words:
        if not w:
            parts.append(_EDGE)
            continue
        head = NOT_AFTER_WORD if _is_word(w[0]) else f"(?<=[{_WORD}])"
        tail = NOT_BEFORE_WORD if _is_word(w[-1]) else f"(?=[{_WORD}])"
        parts.append(head + re.escape(w) + tail)
    return "(?iu)(" + "|".join(parts) + ")"
