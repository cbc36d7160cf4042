"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from verdigraph.plans import graphs, hierarchies
from verdigraph.streaming import triples

_PARTS = (graphs, hierarchies, triples)


def queries() -> dict:
    return {k: q for part in _PARTS for k, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.oracle_sql().items()}
