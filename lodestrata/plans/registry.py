"""All registered queries of the core."""

from __future__ import annotations

from lodestrata.plans import claim_queries, data_queries, index_queries, lookup_queries, more_queries, view_queries

FLAGSHIP = "p1_found"
_MODULES = [data_queries, index_queries, more_queries, lookup_queries, view_queries, claim_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
