"""The subpackage's queries and their SQL."""

from __future__ import annotations

from driftloom.llm import alignment, leaks, packing, pairs, parsing, spans, splitting, truncation

MODULES = [alignment, leaks, packing, pairs, parsing, spans, splitting, truncation]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
