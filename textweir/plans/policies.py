"""Policies of the registered queries: rule words that occur in the test tables."""

from __future__ import annotations

import dataclasses

from ..policy import Policy

WORDS = ("license", "token", "inoran", "Thatin")
KEYWORDS = ("thanedble", "retion", "erlich")
COMPETITORS = ("Enheit", "Thonwh", "witherenrere")

HOUSE = Policy(
    name="House_v1", pii_enabled=True, pii_patterns=("EMAIL", "PHONE", "SSN", "CREDIT_CARD"),
    topics=WORDS, injection_enabled=True, injection_keywords=KEYWORDS,
    external_enabled=True, competitors=COMPETITORS, toxicity_check=True)
SHADOW = dataclasses.replace(HOUSE, name="House_shadow", shadow_mode=True)
PII_ONLY = Policy(name="Pii_only", pii_enabled=True, pii_patterns=("CREDIT_CARD", "EMAIL"))
TOPICS_ONLY = Policy(name="Topics_only", topics=WORDS)
SECRETS = {"TOKEN": r'token = "[0-9a-f]{40}"', "HEX": r"[0-9a-f]{40}"}
