"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import alignment, decontaminate, html_text, language, media, mixing, neardup, pii, quality, secrets, simhash, spelling, substring

MODULES = (substring, pii, decontaminate, quality, neardup, language, mixing, html_text, secrets, media, simhash, spelling, alignment)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
