"""All queries and their SQL, by name."""

from __future__ import annotations

from . import answers, extraction, identifiers, listings, operators, oracles, pages, sources, texts

MODULES = (operators, identifiers, texts, extraction, sources, listings, pages, oracles, answers)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
