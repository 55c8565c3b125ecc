"""The core's queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from driftloom import api
from driftloom.plans import chunks, domains, drift, extraction, graphs, links, logs, pages, references, snapshots, states, texts

MODULES = [api, chunks, domains, drift, extraction, graphs, links, logs, pages, references, snapshots, states, texts]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
