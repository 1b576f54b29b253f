"""DuckDB statements that state the same results as the registered Spark queries."""

from __future__ import annotations

import importlib

FAMILIES = ("features", "pricing", "models", "reports", "monitoring", "streaming")


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        out.update(importlib.import_module(f"oracles.{family}").SQL)
    return out
