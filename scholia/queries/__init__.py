"""Registered queries: every one applies library operators to whole driver tables. Each module has QUERIES and, where SQL can express them, ORACLE_SQL."""

from __future__ import annotations

from . import corpus, estimates, exports, generation, jobs, layouts, maintenance, retrieval, structure

_MODULES = (corpus, structure, layouts, retrieval, maintenance, estimates, exports, jobs, generation)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
