"""Queries and SQL of the training-data operators, one module per problem."""

from __future__ import annotations

from . import garbled, leaks, lookalikes, mixing, nearcopies, neighbours, scans, spans, split

MODULES = (nearcopies, garbled, split, neighbours, scans, lookalikes, leaks, mixing, spans)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
