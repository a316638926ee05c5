"""Queries of the llm operators, each over its whole table with production parameters."""

from __future__ import annotations

from sheaf.llm import queries as q

QUERIES = {f.__name__: f for f in q.ALL}
ORACLES: dict[str, str] = dict(q.SQL)
