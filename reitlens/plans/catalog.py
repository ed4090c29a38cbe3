"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from reitlens.plans.registry import REGISTRY, Entry

QUERY_MODULES = (
    "reitlens.plans.queries",
    "reitlens.plans.queries_market",
    "reitlens.plans.queries_report",
    "reitlens.plans.queries_text",
    "reitlens.plans.queries_misc",
    "reitlens.plans.queries_stream",
    "reitlens.plans.queries_sinks",
)


def registry() -> dict[str, Entry]:
    for mod in QUERY_MODULES:
        importlib.import_module(mod)
    return REGISTRY
