"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from docloom.operators import queries_catalog, queries_hierarchy, queries_retrieval, queries_text

_MODULES = [queries_retrieval, queries_text, queries_catalog, queries_hierarchy]

FLAGSHIP = "hybrid_search"
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
