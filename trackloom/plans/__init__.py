"""Named queries over the test tables, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sequencing", "index", "features", "evaluation", "text", "frames", "streams")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), "SQL", {}).items()}
