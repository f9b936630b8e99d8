"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from cadenza.plans import documents, foresight, more, opportunities, relations, reliability, state, stores, streams, temporal, triggers, vectors

MODULES = (temporal, foresight, relations, reliability, vectors, state, streams, triggers, documents, more, opportunities, stores)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
