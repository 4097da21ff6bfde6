"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text", "panel", "finance", "search")


def gather() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"earshot.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
