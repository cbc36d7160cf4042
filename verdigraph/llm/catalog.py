"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from verdigraph.llm import names, texts

_PARTS = (names, texts)


def queries() -> dict:
    return {k: q for part in _PARTS for k, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.oracle_sql().items()}
