"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, QueryFn

_MODULES = ("detectors", "spans", "conversations", "operations", "streams", "versions")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
