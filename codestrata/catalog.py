"""Registry of the engine's queries and their SQL equivalents."""

from __future__ import annotations

import importlib

from codestrata.plans.registry import ORACLES, QUERIES

FLAGSHIP = "dash_by_kind"
PLANS = ("dashboard", "joins", "ranking", "search", "texts", "moves", "star", "history", "models", "context", "rules", "labelling", "index", "sampling", "exports", "files", "records", "repositories", "summaries")

for _name in PLANS:
    importlib.import_module(f"codestrata.plans.{_name}")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
