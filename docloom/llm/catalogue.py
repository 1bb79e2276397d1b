"""All queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from docloom.llm import dedup, main_body, neighbours, packing, residue, site_lines, splitting, tokens

_MODULES = [dedup, neighbours, site_lines, main_body, splitting, tokens, packing, residue]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
