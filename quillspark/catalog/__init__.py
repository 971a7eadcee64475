"""The registered queries and their SQL twins, by subsystem."""

from __future__ import annotations

from . import dedup, enrichment, extraction, operations, report, search

MODULES = (dedup, search, extraction, enrichment, report, operations)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
