"""All queries of the catalogue engine."""

from __future__ import annotations

from galena.plans import browse_queries, content_queries, store_queries, sync_queries, upkeep_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (browse_queries, sync_queries, content_queries, upkeep_queries, store_queries):
    QUERIES |= _m.R.queries
    ORACLES |= _m.R.oracles
