"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from sheaf.plans import lift_queries, more_queries, parsing_queries, record_queries, workflow_queries

QUERIES = {**parsing_queries.QUERIES, **record_queries.QUERIES, **workflow_queries.QUERIES, **more_queries.QUERIES, **lift_queries.QUERIES}
ORACLES = {**parsing_queries.ORACLES, **record_queries.ORACLES, **workflow_queries.ORACLES, **more_queries.ORACLES, **lift_queries.ORACLES}
