"""Policies: what a scan looks for. Loaded on the driver, compiled into columns."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

from .functions.rules import BASE_INTENTS, INJECTION_KEYWORDS, unique

# The keys that have an effect; anything else in a file is reported.
_READ_KEYS = {
    "profile_name", "description", "shadow_mode",
    "detectors.pii.enabled", "detectors.pii.engine", "detectors.pii.patterns",
    "detectors.topics.enabled", "detectors.topics.block_list",
    "detectors.injection.enabled", "detectors.injection.keywords",
    "detectors.semantic_blocking.enabled", "detectors.semantic_blocking.forbidden_intents",
    "detectors.semantic_blocking.threshold",
    "guardrails.external_hub.enabled", "guardrails.external_hub.competitors",
    "guardrails.external_hub.toxicity_check",
    "plugins.langkit.enabled", "plugins.langkit.threshold",
}


class PolicyWarning(UserWarning):
    """A policy holds keys or settings without effect."""


@dataclass(frozen=True)
class Policy:
    name: str = "Unknown"
    shadow_mode: bool = False
    pii_enabled: bool = False
    pii_engine: str = "regex"
    pii_patterns: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    injection_enabled: bool = False
    injection_keywords: tuple[str, ...] = ()  # added to the built-in ones
    semantic_enabled: bool = False
    forbidden_intents: tuple[str, ...] = ()   # added to the base intents
    semantic_threshold: float = 0.45
    external_enabled: bool = False
    competitors: tuple[str, ...] = ()
    toxicity_check: bool = False
    toxicity_enabled: bool = False
    toxicity_threshold: float = 0.5
    unread_keys: tuple[str, ...] = field(default=(), compare=False)

    @property
    def effective_keywords(self) -> list[str]:
        return unique((*INJECTION_KEYWORDS, *self.injection_keywords))

    @property
    def effective_intents(self) -> list[str]:
        return unique((*self.forbidden_intents, *BASE_INTENTS))

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Policy:
        """Build from a nested mapping; unread keys and idle settings raise a warning."""
        detectors = config.get("detectors") or {}
        pii, topics, injection, semantic = (
            detectors.get(k) or {} for k in ("pii", "topics", "injection", "semantic_blocking"))
        external = (config.get("guardrails") or {}).get("external_hub") or {}
        toxicity = (config.get("plugins") or {}).get("langkit") or {}
        unread = tuple(k for k in _leaf_keys(config) if k not in _READ_KEYS)
        policy = cls(
            name=config.get("profile_name", "Unknown"),
            shadow_mode=bool(config.get("shadow_mode", False)),
            pii_enabled=bool(pii.get("enabled", False)),
            pii_engine="entities" if pii.get("engine") == "presidio" else "regex",
            pii_patterns=tuple(pii.get("patterns") or ()),
            topics=tuple(topics.get("block_list") or ()) if topics.get("enabled", False) else (),
            injection_enabled=bool(injection.get("enabled", False)),
            injection_keywords=tuple(injection.get("keywords") or ()),
            semantic_enabled=bool(semantic.get("enabled", False)),
            forbidden_intents=tuple(semantic.get("forbidden_intents") or ()),
            semantic_threshold=float(semantic.get("threshold", 0.45)),
            external_enabled=bool(external.get("enabled", False)),
            competitors=tuple(external.get("competitors") or ()),
            toxicity_check=bool(external.get("toxicity_check", False)),
            toxicity_enabled=bool(toxicity.get("enabled", False)),
            toxicity_threshold=float(toxicity.get("threshold", 0.5)),
            unread_keys=unread,
        )
        if unread:
            warnings.warn(f"{policy.name}: keys without effect: {', '.join(unread)}",
                          PolicyWarning, stacklevel=2)
        if policy.pii_enabled and policy.pii_engine == "regex" and not policy.pii_patterns:
            warnings.warn(f"{policy.name}: pii is enabled but lists no patterns",
                          PolicyWarning, stacklevel=2)
        return policy


FALLBACK = Policy(name="FALLBACK", injection_enabled=True)


def _leaf_keys(node: Mapping[str, Any], prefix: str = "") -> Iterator[str]:
    for key, value in node.items():
        path = f"{prefix}{key}"
        if isinstance(value, Mapping):
            yield from _leaf_keys(value, path + ".")
        else:
            yield path


def load_policy(name_or_path: str, search: tuple[str, ...] = (), fallback: bool = False) -> Policy:
    """Resolve a policy: a ``.yaml`` path, a shipped policy, then the ``search`` folders.

    A file that does not parse raises, unless ``fallback`` asks for the minimal
    injection-only policy. A name that is found nowhere always raises.
    """
    import yaml

    path = _resolve(name_or_path, search)
    try:
        with open(path, encoding="utf-8") as handle:
            config = yaml.safe_load(handle)
        if not isinstance(config, Mapping):
            raise ValueError(f"{path}: a policy file must hold a mapping")
        return Policy.from_config(config)
    except (yaml.YAMLError, ValueError, TypeError, AttributeError):
        if fallback:
            return FALLBACK
        raise


def _resolve(name: str, search: tuple[str, ...]) -> str:
    if name.endswith(".yaml") and os.path.exists(name):
        return name
    shipped = resources.files("textweir.policies").joinpath(f"{name}.yaml")
    if shipped.is_file():
        return str(shipped)
    for folder in search:
        candidate = os.path.join(folder, f"{name}.yaml")
        if os.path.exists(candidate):
            return candidate
    raise FileNotFoundError(f"no policy named {name!r}")


def shipped_policies() -> list[str]:
    return sorted(p.name[:-5] for p in resources.files("textweir.policies").iterdir()
                  if p.name.endswith(".yaml"))
