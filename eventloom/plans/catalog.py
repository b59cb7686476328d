"""All registered queries with the SQL that DuckDB runs."""

from __future__ import annotations

from eventloom.plans import content_queries, discovery_queries, feed_queries, lookup_queries, nearby_queries, paged_queries, profile_queries, source_queries, telemetry_queries, upsert_queries

_MODULES = (feed_queries, content_queries, telemetry_queries, source_queries, profile_queries, discovery_queries, nearby_queries, paged_queries, lookup_queries, upsert_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
